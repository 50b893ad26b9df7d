"""What the index does once, in proportion to its input, and with nothing that grows sent to the driver."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from postella import build, load, save
from postella.operators import bitmaps, boolean, mining, specificity
from postella.plans import atlas
from postella.plans.atlas import Atlas
from postella.sources import shared, tables

SF = "/root/testdata/sf0.001"


def cells_and_entries(spark, n=300):
    annotation = spark.range(n).selectExpr("if(id % 2 = 0, 'D', 'E') dataset", "'T' label", "id cell")
    entries = annotation.selectExpr("dataset", "cell", "explode(sequence(0, cast(cell % 5 as int))) g").selectExpr("dataset", "cell", "concat('g', g) gene", "1.0 value")
    return annotation, entries


def test_entries_are_read_once_for_what_is_kept(spark):
    annotation, entries = cells_and_entries(spark)
    n, seen = entries.count(), spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    one = build(annotation, entries.mapInArrow(counting, entries.schema))
    want = sorted(map(tuple, one.cells.collect()))
    before = seen.value
    one.persist()
    assert one.expression.count() == n and sorted(map(tuple, one.cells.collect())) == want and len(want) == 300
    assert seen.value - before == n
    one.unpersist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("kind", ["customer", "classes", "barcodes"])
def test_orders_are_not_broadcast(spark, kind):
    if kind == "barcodes":
        long = []
        real, tables.written = tables.written, lambda df, name: long.append(df) or df
        try:
            tables.driver_atlas(spark, SF, kind)
        finally:
            tables.written = real
        plan = long[0]._jdf.queryExecution().executedPlan().toString()
        assert len(long) == 1
    else:
        plan = tables.driver_atlas(spark, SF, kind).expression._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[l_orderkey#\d+L\], \[o_orderkey#\d+L\]", plan)


def test_tasks_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id", "md5(cast(id as string)) s").write.parquet(str(tmp_path / "x"))
    x = spark.read.parquet(str(tmp_path / "x"))
    assert shared.tasks_for(x) == 1
    monkeypatch.setattr(shared, "TASK_BYTES", 1 << 16)
    assert shared.tasks_for(x) >= 8 and shared.tasks_for(x, x.where("id < 5")) == shared.tasks_for(x)


def test_tasks_of_kept_frames_not_made_yet(spark, tmp_path):
    """Until it is made a kept frame has the product of what it joins for an estimate; what it reads counts."""
    spark.range(1000).write.parquet(f"{tmp_path}/x")
    frames = [spark.read.parquet(f"{tmp_path}/x").select(F.col("id").alias(c)) for c in "abcd"]
    kept = frames[0].crossJoin(frames[1]).crossJoin(frames[2]).crossJoin(frames[3]).persist()
    try:
        assert shared.tasks_for(kept) == shared.tasks_for(kept.where("a < 5")) == 1
    finally:
        kept.unpersist()


def test_signatures_are_judged_by_sets_of_genes(spark):
    annotation, entries = cells_and_entries(spark)
    one = build(annotation, entries).persist()
    ranked = spark.createDataFrame([(t, p, f"g{p - 1}") for t in ("D.T", "E.T") for p in (1, 2, 3)], "target string, position int, gene string")
    judged = specificity._judged(one, ranked, 6, 1, 1.0)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window.*cell_id", plan)  # no row for each cell, list and gene
    # every cell has g0, four of five have g1: the lists end before it
    assert sorted(map(tuple, judged.collect())) == [("D.T", 1, "g0"), ("E.T", 1, "g0")]
    one.unpersist()


def test_a_list_that_no_cell_satisfies_goes_on(spark):
    annotation, entries = cells_and_entries(spark, 60)
    one = build(annotation, entries.where("gene <> 'g1' or cell % 5 = 9")).persist()
    ranked = spark.createDataFrame([("D.T", 1, "none"), ("D.T", 2, "g0")], "target string, position int, gene string")
    assert specificity._judged(one, ranked, 2, 1, 1.0).count() == 2
    one.unpersist()


@pytest.mark.parametrize("dealt", [None, 3])
def test_bitmaps_are_as_long_as_their_cells(spark, dealt):
    annotation, entries = cells_and_entries(spark)
    one = build(annotation, entries).persist()
    made = bitmaps.of_entries(one.expression, dealt)
    assert made.agg(F.max(F.octet_length("bits"))).first()[0] <= 20  # 150 cells of a type are 19 bytes, not 4,096
    packed = Atlas(one.expression, one.cells, one.cell_types, 2, one.supports, one.names, made)
    for terms in (["g0", "g4"], ["*g3", "*g4"], ["g0", "-g2"], ["-g1"], ["g1", "*-g2", "*-g3"]):
        x, y = (sorted(map(tuple, boolean.find(a, terms).collect())) for a in (one, packed))
        assert x == y, terms
    one.unpersist()


def test_a_thin_index_is_saved_whole(spark, tmp_path):
    annotation, entries = cells_and_entries(spark)
    one = build(annotation, entries)
    save(one, str(tmp_path / "i"))
    again = load(spark, str(tmp_path / "i"))
    assert again.bitmaps.agg(F.max(F.octet_length("bits"))).first()[0] <= 20
    assert sorted(map(tuple, again.expression.collect())) == sorted(map(tuple, one.expression.collect()))
    assert again.support.agg(F.sum("n_cells")).first()[0] == again.expression.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("kind", ["barcodes", "orders"])
def test_cells_are_written_once(spark, kind):
    one = tables.driver_atlas(spark, SF, kind)
    assert one.numbered.inputFiles() and all("/cells/" in f for f in one.numbered.inputFiles())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_parts_and_customers_are_not_broadcast(spark, monkeypatch):
    cells = []
    monkeypatch.setattr(atlas, "written", lambda df, name: cells.append(df) or df)
    one = tables.driver_atlas(spark, SF, "orders")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (cells[0], one.expression)]
    assert re.search(r"ShuffledHashJoin \[o_custkey#\d+L\], \[c_custkey#\d+L\]", plans[0])
    assert re.search(r"ShuffledHashJoin \[l_partkey#\d+L\], \[p_partkey#\d+L\]", plans[1])


def test_numbering_follows_the_input(spark, monkeypatch):
    annotation, entries = cells_and_entries(spark)
    monkeypatch.setattr(atlas, "tasks_for", lambda *frames: 23)
    one = build(annotation, entries)
    assert "hashpartitioning(cell_type" in (plan := one.numbered._jdf.queryExecution().executedPlan().toString()) and ", 23)" in plan
    assert "SortAggregate" not in one.cell_types._jdf.queryExecution().executedPlan().toString()


def test_cells_without_values_are_counted(spark):
    annotation, entries = cells_and_entries(spark, 40)
    one = build(annotation, entries.where("cell % 3 = 0"))
    got = {(r.dataset, r.cell_id): (r.reads, r.features) for r in one.cells.collect()}
    assert len(got) == 40 and all(got["D" if c % 2 == 0 else "E", c // 2 + 1] == ((c % 5 + 1.0, c % 5 + 1) if c % 3 == 0 else (0.0, 0)) for c in range(40))


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_bitmaps_of_a_saved_index_are_made_without_a_sort(spark, tmp_path, monkeypatch, batch):
    annotation = spark.range(70_000).selectExpr("if(id < 3, 'D', 'E') dataset", "if(id % 9 = 0, 'T', 'U') label", "id cell")
    entries = annotation.where("cell < 400 or cell > 69900").selectExpr("dataset", "cell", "explode(sequence(0, cast(cell % 5 as int))) g").selectExpr("dataset", "cell", "concat('g', g) gene", "1.0 value")
    one = build(annotation, entries).persist()
    want = sorted(map(tuple, bitmaps.of_entries(one.expression).collect()))
    assert len({r[3] for r in want}) > 1
    monkeypatch.setattr(tables, "THIN", 0)
    monkeypatch.setattr(tables, "of_entries", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        save(one, str(tmp_path / "i"))
        got = load(spark, str(tmp_path / "i")).bitmaps.select("gene", "cell_type", "dataset", "block", "bits", "n")
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        one.unpersist()


def test_transactions_are_made_once(spark, monkeypatch):
    annotation, entries = cells_and_entries(spark)
    one, names = build(annotation, entries).persist(), []
    monkeypatch.setattr(mining, "written", lambda df, name: names.append(name) or shared.written(df, name))
    got = sorted((r.query, r.n_cells) for r in mining.frequent_sets(one, ["g2", "g3", "g4"]).collect())
    assert got == [("g2,g3", 120), ("g2,g3,g4", 60), ("g2,g4", 60), ("g3,g4", 60)] and names == ["transactions"]
    one.unpersist()


def test_saved_entries_stand_in_order(spark, tmp_path):
    annotation, entries = cells_and_entries(spark)
    save(build(annotation, entries), str(tmp_path / "i"))
    again = load(spark, str(tmp_path / "i")).expression
    for f in again.inputFiles():
        rows = [(r.gene, r.cell_type, r.cell_id) for r in spark.read.parquet(f).coalesce(1).collect()]
        assert rows == sorted(rows)


def test_numbered_cells_are_not_broadcast(spark):
    annotation, entries = cells_and_entries(spark)
    plan = build(annotation, entries, write_cells=True).expression._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[dataset#\d+, cell#\d+L\], \[dataset#\d+, cell#\d+L\]", plan)
