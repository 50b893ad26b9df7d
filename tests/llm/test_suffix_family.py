"""A stored family of suffix indexes: batches against one call over all of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postella.llm import anchors
from postella.llm.suffix_dedup import suffix_dedup
from postella.llm.suffix_family import SuffixFamily
from postella.sources.manifest import Manifest

from .conftest import by_id, passage, texts_of

SCHEMA = "doc_id long, text string"


def result(df):
    return {k: sorted(v) for k, v in by_id(df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()).items()}


def texts(n, seed):
    rng = random.Random(seed)
    shared = [passage(12, 900 + i) for i in range(4)]
    return [" ".join(rng.choice([passage(8, rng.randrange(40)), rng.choice(shared), passage(10, 100 * seed + i)]) for _ in range(4)) for i in range(n)]


@pytest.mark.parametrize("hot", [400, 1])
def test_batches_are_one_call(spark, tmp_path, monkeypatch, hot):
    """Ids ascend from batch to batch, so one call over all has the same results; levels stay few."""
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "SAMPLE", 1)
    rows = [(i, t) for i, t in enumerate(t for b in range(5) for t in texts(12, b))]
    want = result(suffix_dedup(spark.createDataFrame(rows, SCHEMA)))
    family, got = SuffixFamily(spark, str(tmp_path / "f"), parts=3), {}
    for b in range(5):
        got |= result(family.add(spark.createDataFrame(rows[12 * b : 12 * b + 12], SCHEMA).repartition(2), f"b{b}"))
        sizes = family.levels()
        assert all(x.bit_length() > y.bit_length() for x, y in zip(sizes, sizes[1:]))
    assert got == want and sum(v[0][1] for v in want.values()) > 0
    # in passes over parts of what is stored
    monkeypatch.setattr(anchors, "OPENED", 200)
    more = family.add(spark.createDataFrame([(1, rows[3][1]), (2, "new " + passage(30, 77))], SCHEMA), "again").collect()
    assert {r.doc_id: r.n_removed == r.n_bytes for r in more} == {1: True, 2: False}


def test_earlier_batches_are_before_smaller_ids(spark, tmp_path):
    family = SuffixFamily(spark, str(tmp_path / "f"), parts=2)
    t = passage(20)
    assert [r.n_removed for r in family.add(spark.createDataFrame([(9, t)], SCHEMA), "one").collect()] == [0]
    assert [r.n_removed for r in family.add(spark.createDataFrame([(1, t)], SCHEMA), "two").collect()] == [len(t)]


def test_tricky(spark, tmp_path, tricky, empty):
    family = SuffixFamily(spark, str(tmp_path / "f"), parts=2)
    assert family.add(empty, "none").count() == 0
    assert result(family.add(tricky, "all")) == result(suffix_dedup(tricky))
    again = family.add(tricky.toDF(*[f"c{i}" for i in range(10)]).select("c0", "c1").toDF("doc_id", "text"), "twice").collect()
    assert len(again) == len(texts_of(tricky)) and all(r.n_removed == r.n_bytes for r in again if r.n_bytes >= 50)


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    family = SuffixFamily(spark, path, parts=2)
    one = spark.createDataFrame([(1, passage(30))], SCHEMA)
    family.add(one, "one")

    def dies(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", dies)
        with pytest.raises(RuntimeError):
            family.add(spark.createDataFrame([(2, passage(30, 5))], SCHEMA), "two")
    assert Manifest(spark, path).read()[1]["batches"] == ["one"]
    assert [r.n_removed for r in SuffixFamily(spark, path, parts=2).add(spark.createDataFrame([(2, passage(30, 5))], SCHEMA), "two").collect()] == [0]
    # the same batch again has the result it had
    assert [r.n_removed for r in family.add(one, "one").collect()] == [0] and Manifest(spark, path).read()[1]["batches"] == ["one", "two"]
    with pytest.raises(ValueError, match="2 parts"):
        SuffixFamily(spark, path, parts=4).add(one, "three")
