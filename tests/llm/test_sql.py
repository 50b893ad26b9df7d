"""The queries of this subpackage that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from postella.llm import queries

from .conftest import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["op12_importance_resampling", "lm_base_scores", "quality_counts"])
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda r: tuple(round(v, 5) if isinstance(v, float) else v for v in r)
    assert sorted((plain(r) for r in got.select(*columns).collect()), key=repr) == sorted((plain(r) for r in want.fetchall()), key=repr)
