"""The pipeline, stage by stage against plain versions, and the SQL of the queries."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import corpus_pipeline as pipeline
from postella.llm import queries
from postella.llm.lattice import load
from postella.llm.quality import assess
from postella.llm.sentencepiece_codec import MODEL, encode_texts

from .conftest import SF, texts_of
from .test_dedup import brute_bytes, order
from .test_decontaminate import brute as brute_hits
from .test_decontaminate import whole_windows
from .test_set_dedup import brute_kept


def cut(rows):
    """Texts less the bytes of 50-byte strings that also start in a smaller id."""
    first: dict = {}
    for d, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], order(d)), order(d))
    out = {}
    for d, t in rows:
        b = np.frombuffer((t or "").encode(), np.uint8)
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50].tobytes()] < order(d):
                gone[s : s + 50] = True
        left = b[~gone].tobytes().decode("utf-8", "ignore")
        if not gone.any() or left.strip(" \t\n\r\v\f"):
            out[d] = left
    return out


def test_stages(spark, documents):
    got = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    rows = documents.select("doc_id", "text")
    good = {r.doc_id for r in assess(rows, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    kept = [(d, t) for d, t in texts_of(rows) if d in good]
    names = set(brute_kept(kept))
    kept = [(d, t) for d, t in kept if d in names]
    left = cut(kept)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits(list(left.items()), items)
    whole = whole_windows(list(left.items()), items)
    clean = {d: t for d, t in left.items() if not hits[d][0][-1] and d not in whole}
    assert set(got) == set(clean)
    ids = list(clean)
    pieces, counts = encode_texts(load(MODEL), np.array(ids), [clean[d].encode() for d in ids], 0, 0.5)
    ends = np.r_[0, np.cumsum(counts)]
    for i, d in enumerate(ids):
        assert got[d].lossless and got[d].pieces == pieces[ends[i] : ends[i + 1]].tolist()


def test_stages_take_tricky_rows(spark, tricky, empty):
    for docs in (tricky, empty):
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
        assert [name for name, _ in pipeline.STAGES][0] == "quality_rules"
    assert brute_bytes([(1, "x")])[1][0][1] == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())
