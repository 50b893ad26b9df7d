"""Whitening against a covariance that is made and decomposed whole."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postella.llm import queries, whitening
from postella.llm.whitening import lobpcg, whiten

from .conftest import SF

NAN, INF = math.nan, math.inf


def brute(vectors, k=4):
    """n, sums, mean, eigenvalues and vectors of the distinct scaled vectors' covariance."""
    x = np.unique(np.floor(256 * np.array(vectors, float)).astype(np.int64), axis=0)
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, s, s / n, e[::-1][:k], v[:, ::-1][:, :k], np.trace(c.T @ c / n)


def compare(df, rows, k=4, close=1e-7):
    """Every row's values, components up to their sign."""
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    n, s, mean, e, v, trace = brute([x for _, x in rows], k)
    ids = [i for i, _ in rows]
    assert set(got) == set(ids)
    for j in range(min(k, len(s))):
        want = np.array([(np.floor(256 * np.array(x, float)) - mean) @ v[:, j] / math.sqrt(e[j]) for _, x in rows])
        have = np.array([got[i][j + 1][0].whitened for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < close
        for i, x in rows:
            r = got[i][j + 1][0]
            exact = sum((n * int(math.floor(256 * c)) - int(t)) ** 2 for c, t in zip(x, s, strict=True))
            assert int(r.deviation) == exact and r.n == n and r.explained == pytest.approx(e[j] / trace, rel=1e-6) and r.identity_error < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, VEC_ID string").toDF("vec_id", "embedding", "n", "vec_id").repartition(3)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(queries.op11_embedding_whitening(spark, SF), rows)


def test_odd_rows_are_left_out_and_repeats_count_once(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.2]]) for i in range(60)]
    twins = [(100 + i, good[0][1]) for i in range(300)] + [(None, good[1][1])]
    bad = [(200, None), (201, [1.0, None] + [0.0] * 4), (202, [NAN] + [0.0] * 5), (203, [INF] + [0.0] * 5), (204, [-INF] + [0.0] * 5), (205, [1.0]), (206, [])]
    df = frame(spark, [(i, x, 1, "z") for i, x in good + twins + bad])
    out = whiten(df)
    assert out.count() == 4 * len(good + twins)
    compare(out, [*good, *twins])


@pytest.mark.parametrize("d", [1, 2, 3])
def test_fewer_entries_than_components(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=d) * np.arange(d, 0, -1)]) for i in range(40)]
    out = whiten(frame(spark, [(i, x, 1, "z") for i, x in rows]))
    assert out.count() == 40 * d
    compare(out, rows, d)


def test_nothing_varies(spark):
    one = whiten(frame(spark, [(i, [1.5, -2.0], 1, "z") for i in range(5)])).collect()
    assert len(one) == 10 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, None)}
    line = whiten(frame(spark, [(i, [float(i), 2.0], 1, "z") for i in range(5)])).collect()
    assert {r.whitened for r in line if r.component == 2} == {None} and {r.identity_error for r in line} != {None}
    assert sorted(abs(r.whitened) for r in line if r.component == 1) == pytest.approx([0, 0.5**0.5, 0.5**0.5, 2**0.5, 2**0.5])


def test_empty(spark):
    df = frame(spark, [(1, None, 1, "z"), (2, [], 1, "z")])
    assert whiten(df).count() == whiten(df.limit(0)).count() == 0
    assert whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("beyond", [False, True])
def test_exact_sums_beyond_longs(spark, beyond):
    """Entries so large that squares need more than 64 bits, and beyond the range of longs."""
    rows = [(i, [float(i * 2.0**40), -float(i), 1e30 if i == 3 else 0.5]) for i in range(7)]
    rows = rows if beyond else [(i, v[:2]) for i, v in rows]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    x = [[min(math.floor(256 * c), 2**63 - 1) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((7 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    assert [got[i] for i in range(7)] == [w if w < 10**38 else None for w in want]


@pytest.mark.parametrize(("d", "spread"), [(200, "flat"), (300, "decay"), (120, "ties"), (90, "rank")])
def test_block_iteration(d, spread):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"flat": np.linspace(2, 1, d), "decay": 1 / np.arange(1, d + 1), "ties": np.repeat([5.0, 2.0, 1.0], [2, 5, d - 7]), "rank": np.r_[[3.0, 2.0], np.zeros(d - 2)]}[spread]
    v = q * e @ q.T
    values, vectors, residuals, steps = lobpcg(lambda b: v @ b, d, 4)
    assert np.abs(values - e[:4]).max() < 1e-12 and residuals.max() < whitening.ACCEPT and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert 1 < steps < 200


def test_a_broken_product_is_an_error(monkeypatch):
    monkeypatch.setattr(whitening, "STEPS", 20)
    rng = np.random.default_rng(0)
    with pytest.raises(ArithmeticError, match="residuals"):
        lobpcg(lambda b: rng.standard_normal(b.shape), 100, 4)


def test_order_of_rows_is_no_matter(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = ({(r.vec_id, r.component): r.whitened for r in whiten(x).collect()} for x in (df.repartition(2), df.orderBy(F.desc("vec_id"))))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-8
