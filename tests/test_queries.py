"""Every query of the index against DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from postella import queries as index
from postella.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(index.oracle_sql()))
@pytest.mark.filterwarnings("ignore::UserWarning")
def test_query(spark, duck, name):
    got = index.queries()[name](spark, SF)
    want = duck.execute(index.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and math.isclose(p, q, abs_tol=2e-5))


@pytest.fixture(scope="module")
def reloaded(spark, tmp_path_factory):
    """The indexes as they are after being saved and loaded, not kept in memory."""
    from postella import load, save

    path = tmp_path_factory.mktemp("saved")
    known = {}

    def get(session, sf_dir, kind="orders"):
        if kind not in known:
            save(tables.driver_atlas(session, sf_dir, kind), str(path / kind))
            known[kind] = load(session, str(path / kind))
        return known[kind]

    return get


@pytest.mark.parametrize("name", ["gene_support_ct", "mixed_query", "hyper_query", "markers_topk", "ct_specificity", "signature_pval", "similar_genes", "marker_genes", "quantized_expression", "cell_type_expression", "umap_hits", "decode_posting"])
@pytest.mark.filterwarnings("ignore::UserWarning")
def test_query_of_a_reloaded_index(spark, duck, reloaded, monkeypatch, name):
    monkeypatch.setattr(index, "atlas", reloaded)
    test_query(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).columns == ["cell_type", "cell_hits", "total_cells", "pval"]


def test_filters_reach_the_scan(spark, tmp_path):
    from postella import load, save
    from postella.operators import boolean

    save(index.atlas(spark, SF), str(tmp_path / "i"))
    a = load(spark, str(tmp_path / "i"))
    plan = boolean.find(a, ["Brand#1", "Brand#2"], ["ASIA"])._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan") :]
    assert "(dataset" in scan[scan.index("PartitionFilters") :] and "PushedFilters: [In(gene" in scan and "value" not in scan[scan.index("ReadSchema") :].split("\n")[0]
