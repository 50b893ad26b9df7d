"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pytest

from postella.llm import importance, queries
from postella.llm.importance import rank_offsets, resample

from .conftest import SF, pairs, texts_of

LOW = -(1 << 63)


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(w, longest):
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    """(id, features, weight, score, rank) of the rows, sorted."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = [0] * buckets, [0] * buckets
    for counts, texts in ((source, [t for _, t in rows]), (wanted, target)):
        for t in texts:
            for f in runs(words(t), longest):
                counts[of(f)] += 1
    s, t = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(source, wanted, strict=True)]
    out = []
    for d, text in rows:
        w = words(text)
        f = runs(w, longest)
        weight = sum(gain[of(x)] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], LOW if r[0] is None else r[0], r[1], r[2]))
    drawn = percent * len(fit) // 100
    ranked = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(fit)]
    return sorted([*ranked, *[(*r[:4], None) for r in out if not r[4]]], key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"percent": 60, "least": 1}, {"longest": 3, "buckets": 500, "percent": 30}])
def test_tricky(spark, tricky, documents, how):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = result(resample(tricky, target, how.get("percent", 10), how.get("least", 20), how.get("longest", 1), how.get("buckets", 10_000)))
    assert got == brute(texts_of(tricky), [r.text for r in target.collect()], **how)


def test_whole_table(spark, documents):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = result(queries.op12_importance_resampling(spark, SF))
    assert got == brute(pairs(documents), target) and sum(r[4] is not None for r in got) == 10 * sum(len(words(t)) >= 20 for _, t in pairs(documents)) // 100


def test_empty(spark, empty, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(empty, none).count() == 0 and resample(empty, none).columns == importance.OUT
    assert result(resample(documents, none)) == brute(pairs(documents), [])
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r[1:3] + (r[4],) for r in result(resample(nulls, none))] == [(0, 0, None)] * 2


def test_very_many_equal_rows(spark, monkeypatch):
    """A third of all rows are one row: they are ranked from a count, across the cutoff, in steps."""
    monkeypatch.setattr(importance, "STEP", 7)
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(5, text)] * 100 + [(i, f"{text} x{i % 9}") for i in range(10, 210)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (1, 10, 40, 100):
        assert result(resample(df, df, percent)) == brute(rows, [t for _, t in rows], percent)


@pytest.mark.parametrize("digit", [1, 3, 11])
def test_offsets_by_digits(spark, monkeypatch, digit):
    monkeypatch.setattr(importance, "DIGIT", digit)
    scores = [0, 1, -1, 7, 8, 1 << 40, -(1 << 40), 12345678901, -5, (1 << 40) + 3]
    h = spark.createDataFrame([(s, i + 1) for i, s in enumerate(scores)], "score long, n long")
    got = {r.score: r.above for r in rank_offsets(h).collect()}
    assert got == {s: sum(j + 1 for j, x in enumerate(scores) if x > s) for s in scores}
