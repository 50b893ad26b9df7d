"""Decontamination against plain window search."""

from __future__ import annotations

import hashlib
import re

import pytest

from postella.llm import decontaminate as d
from postella.llm import queries

from .conftest import LONG, SF, by_id, passage, texts_of
from .test_simhash import lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, items):
    found: dict = {}
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for s in range(max(len(w) - 12, 1) if w else 0):
            found.setdefault(tuple(w[s : s + 13]), set()).add("null" if i is None else str(i))
    sizes = {len(k) for k in found}
    out = []
    for doc, t in rows:
        w = WORD.findall(lower(t or ""))
        hit, names = [0] * len(w), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if k := found.get(tuple(w[s : s + m])):
                    names |= k
                    hit[s : s + m] = [1] * m
        n = sum(hit)
        out.append((doc, len(w), n, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return by_id(out)


def result(df):
    return by_id([(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r.items).encode()).hexdigest(), r.contaminated) for r in df.collect()])


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, LONG), (2, LONG.upper()), (2, None), (3, ""), (4, "naïve café"), (None, passage(14)), (5, "!?"), (6, "zero"), (7, "x" * 3000)]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [1 << 20, 10, 200])
def test_tricky(tricky, items, monkeypatch, limit):
    monkeypatch.setattr(d, "ITEM_BYTES", limit)
    assert result(d.decontaminate(tricky, items)) == brute(texts_of(tricky), [tuple(r) for r in items.collect()])


def test_query(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert by_id(queries.op4_benchmark_decontamination(spark, SF).collect()) == brute(texts_of(documents), items)


def test_empty(empty, tricky, items):
    assert d.decontaminate(empty, items).count() == 0
    assert {r.contaminated for r in d.decontaminate(tricky, items.limit(0)).collect()} == {False}


def test_offsets_point_into_the_original(spark, items):
    text = f"Ünder… {LONG.title()}?! naïve, CAFé end"
    r = d.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).first()
    raw = text.encode()
    assert [raw[s.first : s.end].decode() for s in r.hit_spans] == [f"{LONG.title()}?! naïve, CAFé"]


def whole_windows(rows, items):
    """Ids of documents that hold 13 words in a row of an item."""
    known = {tuple(w[s : s + 13]) for _, t in items for w in [WORD.findall(lower(t or ""))] for s in range(len(w) - 12)}
    return {d for d, t in rows for w in [WORD.findall(lower(t or ""))] if any(tuple(w[s : s + 13]) in known for s in range(len(w) - 12))}


@pytest.mark.parametrize("limit", [1 << 20, 10])
def test_keep_clean(tricky, items, monkeypatch, limit):
    monkeypatch.setattr(d, "ITEM_BYTES", limit)
    out = d.keep_clean(tricky, items)
    listed = [tuple(r) for r in items.collect()]
    bad = {k for k, v in brute(texts_of(tricky), listed).items() if v[0][-1]} | whole_windows(texts_of(tricky), listed)
    assert out.columns == tricky.columns
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(repr(tuple(r)) for r in tricky.collect() if r[0] not in bad)


def test_no_passage_is_left(spark):
    """Long documents, of which a passage is less than a twentieth."""
    rows = [(i, f"{passage(1000, i)} {LONG if i % 2 else LONG[:60]} {passage(1000, i + 50)}") for i in range(8)]
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    kept = d.keep_clean(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6]
    assert not d.decontaminate(kept, items).where("whole or contaminated").count()


def test_many_documents_with_one_window(spark, monkeypatch):
    """A hot window, by both ways."""
    rows = [(i, f"{passage(5, i)} {LONG}") for i in range(300)] + [(None, LONG), (None, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(i, LONG) for i in range(20)], "item_id long, text string")
    got = []
    for limit in (1 << 20, 10):
        monkeypatch.setattr(d, "ITEM_BYTES", limit)
        got.append(sorted(map(repr, d.decontaminate(docs, items).collect())))
    assert got[0] == got[1] and len(got[0]) == 302
