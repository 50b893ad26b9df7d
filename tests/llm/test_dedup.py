"""Substring and suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postella.llm import anchors, queries
from postella.llm.anchors import STEP, Spec, grams, runs_of, sliding_min
from postella.llm.common import NULL_ID
from postella.llm.substring_dedup import substring_dedup
from postella.llm.suffix_dedup import SuffixLevels, cut_repeats, distinct, suffix_dedup

from .conftest import SF, by_id, texts_of

LOW = -(1 << 63)


def order(i):
    return LOW if i is None else i


def brute_words(rows, length=20):
    words = [(order(d), (t or "").encode().split()) for d, t in rows]
    first: dict = {}
    for d, w in words:
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, (d, s)), (d, s))
    out = []
    for (d, _), (o, w) in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (o, s):
                gone[s : s + length] = True
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return by_id(out)


def brute_bytes(rows, length=50):
    texts = [(order(d), (t or "").encode()) for d, t in rows]
    first: dict = {}
    for d, t in texts:
        for s in range(len(t) - length + 1):
            k = t[s : s + length]
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), (o, t) in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < o:
                gone[s : s + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return by_id(out)


def words_result(df, **kw):
    return by_id(substring_dedup(df, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())


def bytes_result(df, **kw):
    return by_id(suffix_dedup(df, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


def test_tricky_words(tricky):
    assert words_result(tricky) == brute_words(texts_of(tricky))


def test_tricky_bytes(tricky):
    assert bytes_result(tricky) == brute_bytes(texts_of(tricky))


@pytest.fixture
def split(monkeypatch):
    """All anchors hot or, with many passes, none."""

    def put(**how):
        for k, v in how.items():
            monkeypatch.setattr(anchors, k, v)

    return put


@pytest.mark.parametrize("how", [dict(SAMPLE=1, HOT=1), dict(SAMPLE=1, HOT=3, WINDOWS=50), dict(OPENED=1, PARTITION=1 << 30)])
def test_hot_anchors_and_passes(tricky, split, how):
    split(**how)
    rows = texts_of(tricky)
    assert words_result(tricky) == brute_words(rows) and bytes_result(tricky) == brute_bytes(rows)


@pytest.mark.parametrize("how", [dict(SAMPLE=1, HOT=50), dict(SAMPLE=1, HOT=10**9)])
def test_one_anchor_in_most_documents(spark, split, how):
    """A line that stands in most documents, between other words in each, so its runs all differ; hot or not."""
    split(**how)
    rng = random.Random(3)
    line = "this line of words stands in most of the documents that there are here"
    own = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    rows = [(i, f"{own(12)} {line} {own(12)}" if i % 4 else own(30)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if how["HOT"] == 50:
        for spec in (Spec(20, 6, True, False), Spec(50, 12, False, True)):
            assert len(anchors.hot_anchors(df.selectExpr("doc_id k", "text t"), spec))
    assert words_result(df) == brute_words(rows) and bytes_result(df) == brute_bytes(rows)


def test_windows_of_a_hot_anchor_are_sent_once_a_task(split):
    """What moves for an anchor in all documents is its windows that the task hasn't met."""
    spec = Spec(50, 12, False, True)
    line = "this line of words stands in most of the documents that there are here, whole and unchanged. "
    texts = [f"{i:08d}{line * 2}{i:08d}" for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], names=["k", "t"])
    every = np.sort(np.concatenate([b.column(0).to_numpy().view(np.uint64) for b in anchors.anchor_counter(spec)([batch])]))
    sent = []
    for hot in (np.zeros(0, np.uint64), np.unique(every)):
        rows = [(k, anchors.unpack(x)) for b in anchors.run_mapper(spec, 4, type("B", (), {"value": hot}), type("B", (), {"value": np.zeros(anchors.SLOTS, bool)}))([batch]) for k, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        sent.append({kind: sum(len(x[0]) for k, x in rows if k == kind) for kind in (anchors.RUNS, anchors.HASHES)})
    # in 2000 documents the line's own windows are the same; only those that reach into the numbers differ
    own = len({t[s : s + 50] for t in texts for s in range(len(t) - 49)})
    assert sent[1][anchors.HASHES] <= own + 200 and sent[1][anchors.RUNS] == 0 and sent[0][anchors.HASHES] == 0


def test_empty(empty):
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0 and cut_repeats(empty).count() == 0


def test_queries(spark, documents):
    rows = texts_of(documents)
    assert by_id(queries.op2_substring_dedup(spark, SF).collect()) == brute_words(rows)
    assert by_id(queries.op5_suffix_array_dedup(spark, SF).collect()) == brute_bytes(rows)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_random_texts_with_few_letters(spark, alphabet):
    rng = random.Random(alphabet)
    rows = [(rng.randrange(40), "".join(rng.choices(alphabet + " ", k=rng.randrange(300)))) for _ in range(60)]
    rows = list(dict(rows).items())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert words_result(df, length=5, k=2) == brute_words(rows, 5)
    assert bytes_result(df, length=9, k=3) == brute_bytes(rows, 9)
    assert bytes_result(df, length=4, k=4) == brute_bytes(rows, 4)


def test_parameters(spark, tricky):
    with pytest.raises(ValueError, match="k must"):
        substring_dedup(tricky, length=3, k=4)
    with pytest.raises(ValueError, match="k must"):
        suffix_dedup(tricky, length=3, k=0)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_sliding_min_and_grams(values, k):
    x = np.array(values, np.uint64)
    if k <= len(x):
        assert sliding_min(x, k).tolist() == [min(values[i : i + k]) for i in range(len(x) - k + 1)]
        g = grams(x + np.uint64(1), k)
        same = {}
        for i in range(len(g)):
            assert same.setdefault(tuple(values[i : i + k]), g[i]) == g[i]
        assert len(set(same.values())) == len(same)


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_runs_cover_each_window_once(docs):
    spec = Spec(8, 3, words=False, across=True)
    offs = np.r_[0, np.cumsum([len(d) for d in docs])]
    h = np.array([v for d in docs for v in d], np.uint64) + np.uint64(1)
    d, first, n, at = runs_of(h, offs, spec)
    got = sorted(w for f, m in zip(first, n, strict=True) for w in range(f, f + m))
    assert got == [s for i in range(len(docs)) for s in range(offs[i], offs[i + 1] - 7)]
    assert ((at >= first + n - 1) & (at + 3 <= first + 8)).all()


def test_runs_across_steps():
    spec = Spec(50, 12, words=False, across=True)
    h = np.random.default_rng(0).integers(1, 1 << 60, STEP + 500).astype(np.uint64)
    _, first, n, _ = runs_of(h, np.array([0, len(h)]), spec)
    assert int(n.sum()) == len(h) - 49 and (np.sort(first)[1:] == (np.sort(first) + n[np.argsort(first)])[:-1]).all()


def test_levels_grow_geometrically():
    rng, levels, known = np.random.default_rng(1), SuffixLevels(), {}
    for batch in range(40):
        raw = np.array([f"{v:04d}" for v in rng.integers(0, 3000, 64)], "S4")
        keys, docs = distinct(raw, np.full(64, batch))
        assert levels.scan(keys, docs).tolist() == [known.get(k, batch) for k in keys.tolist()]
        fresh = levels.scan(keys, docs)
        levels.append(keys, fresh)
        for k, d in zip(keys.tolist(), fresh.tolist(), strict=True):
            known.setdefault(k, d)
        assert len(levels.levels) <= 8


def test_cut_repeats(spark, tricky):
    out = {r[0]: r for r in cut_repeats(tricky).collect()}
    assert cut_repeats(tricky).columns == tricky.columns
    rows = dict(texts_of(tricky))
    assert 2 not in out  # a whole copy goes
    assert out[4][1] is None and out[5][1] == "" and out[6][1] == rows[6] and out[16][1] == rows[16]
    assert len(out[3][1]) < len(rows[3]) and out[3][4] == len(out[3][1]) and out[3][5] == "no"


def test_cut_inside_a_character(spark):
    rows = [(1, "é" * 60), (2, "x" + "é" * 30 + "yz")]
    out = dict(texts_of(cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert out[2] == "xyz"


def colliding(want: str, make) -> str:
    """A text whose hash's low 16 bits are those of the wanted one's."""
    import xxhash

    low = xxhash.xxh3_64_intdigest(want.encode()) & 0xFFFF
    return next(t for i in range(1 << 22) if xxhash.xxh3_64_intdigest((t := make(i)).encode()) & 0xFFFF == low)


def test_texts_under_one_id_are_told_apart(spark):
    """Texts that share an id, and the low bits of their hashes: each has its own cuts."""
    a = passage_of(60, 1)
    y = colliding(a, lambda i: f"{passage_of(61, 2)} {i}")
    rows = [(1, a), (2, a), (2, y), (3, y), (3, None), (3, ""), (4, "short"), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    in_any_order = lambda got: {k: sorted(v) for k, v in got.items()}
    assert in_any_order(words_result(df)) == in_any_order(brute_words(rows))
    assert in_any_order(bytes_result(df)) == in_any_order(brute_bytes(rows))
    left = sorted((r.doc_id, r.text or "") for r in cut_repeats(df).collect())
    assert (2, y) in left and (2, a) not in left and (1, a) in left


def passage_of(n: int, seed: int) -> str:
    return " ".join(f"v{(i * 7919 + seed * 104729) % 99991:x}" for i in range(n))


def test_ids_that_stand_twice(spark):
    ids = [1, 1, 2, None, None, 5, 7, 7, 7]
    seen = anchors.repeated_ids(spark.createDataFrame([(i,) for i in ids], "k long").repartition(3))
    assert [bool(x) for x in seen[anchors._slot(np.array([1, 2, NULL_ID, 5, 7]))]] == [True, False, True, False, True]
