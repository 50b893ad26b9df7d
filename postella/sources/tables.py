"""Sources and sinks: long and wide matrices, Parquet indexes that grow by parts, CSV, atlases of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bitmaps import THIN, of_entries, of_ordered
from ..plans.atlas import VERSION, Atlas, added_genes, build, check_dataset_name, check_types_apart, merge
from .manifest import Manifest
from .shared import tasks_for, written

#: The tables of a part; schemas are given, so reading opens no file to find them.
TABLES = {
    "expression": "cell_type string, cell_id long, gene string, value double, dataset string",
    "cells": "dataset string, cell_type string, cell_id long, reads double, features long",
    "cell_types": "cell_type string, dataset string, label string, total_cells long",
    "support": "gene string, cell_type string, dataset string, n_cells long",
    "genes": "gene string, lc string, total_reads long",
    "bitmaps": "gene string, cell_type string, block long, bits binary, n long, dataset string",
}


def from_wide(wide: DataFrame, dataset: str, cell_col: str = "cell", label_col: str = "cell_type1", assay_genes: list[str] | None = None, qb: int = 2) -> Atlas:
    """A cells-by-genes frame with one column for each gene."""
    check_dataset_name(dataset)
    genes = assay_genes or [c for c in wide.columns if c not in (cell_col, label_col)]
    if missing := [c for c in (cell_col, label_col, *genes) if c not in wide.columns]:
        raise ValueError(f"no columns {missing}")
    annotation = wide.select(F.lit(dataset).alias("dataset"), F.col(label_col).alias("label"), F.col(cell_col).alias("cell"))
    entries = wide.select(F.col(cell_col).alias("cell"), *[F.col(f"`{g}`").cast("double").alias(g) for g in genes]).unpivot(["cell"], None, "gene", "value").where("value > 0")
    return build(annotation, entries.withColumn("dataset", F.lit(dataset)), qb)


def merge_wide(atlas: Atlas, wide: DataFrame, dataset: str, **kw) -> Atlas:
    """The index with one more dataset, built from a cells-by-genes frame with the index's quantisation."""
    return merge(atlas, from_wide(wide, dataset, qb=atlas.qb, **kw))


def from_long(long: DataFrame, qb: int = 2) -> Atlas:
    """(dataset, label, cell, gene, value), where a cell without values stands once with a null gene. Cells and entries are both
    taken from it, more than once, so it is written first, and its cells by `build`: what either comes from is read once."""
    long = written(long.select("dataset", "label", "cell", "gene", "value"), "long")
    return build(long.select("dataset", "label", "cell").distinct(), long.where("gene is not null").select("dataset", "cell", "gene", "value"), qb, write_cells=True)


def _write_part(atlas: Atlas, path: str, part: str) -> None:
    """Entries and bitmaps are laid out by dataset and in the order of genes: a query reads the datasets and genes that it names.
    They are dealt by range, so a gene of very many cells is more than one task's, among more tasks the more there is; their
    order begins with the dataset, or the write would sort by that alone. What is derived from the entries is made of
    those just written, unless the index has it."""
    spark = atlas.spark
    at = lambda name: f"{path}/{name}/part={part}"
    n = atlas.tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    atlas.expression.repartitionByRange(n, "dataset", "gene", "cell_type", "cell_id").sortWithinPartitions("dataset", "gene", "cell_type", "cell_id").write.mode("overwrite").partitionBy("dataset").parquet(at("expression"))
    for name in ("cells", "cell_types"):
        getattr(atlas, name).write.mode("overwrite").parquet(at(name))
    entries = _read(spark, path, [part], "expression")
    # bits are mostly runs of zeros or dense: either way zstd takes little
    bitmaps = atlas.bitmaps
    if bitmaps is None:
        counts = atlas.supports if atlas.supports is not None else entries.groupBy("gene", "cell_type").agg(F.count("*").alias("n_cells"))
        bitmaps = (of_entries if (counts.agg(F.avg("n_cells")).first()[0] or 0) < THIN else of_ordered)(entries, n)
    bitmaps.repartitionByRange(n, "dataset", "gene", "cell_type", "block").sortWithinPartitions("dataset", "gene", "cell_type", "block").write.mode("overwrite").partitionBy("dataset").option("compression", "zstd").parquet(at("bitmaps"))
    counted = _read(spark, path, [part], "bitmaps").groupBy("gene", "cell_type", "dataset").agg(F.sum("n").alias("n_cells"))
    counted.repartitionByRange(n, "gene", "cell_type").sortWithinPartitions("gene", "cell_type").write.mode("overwrite").parquet(at("support"))
    genes = _read(spark, path, [part], "support").groupBy("gene").agg(F.sum("n_cells").alias("total_reads")).select("gene", F.lower("gene").alias("lc"), "total_reads")
    genes.repartitionByRange("lc", "gene").sortWithinPartitions("lc", "gene").write.mode("overwrite").parquet(at("genes"))


def save(atlas: Atlas, path: str) -> int:
    """Make the index that which the path holds, and return the number of its snapshot. What was there before stays readable
    by its own number until `expire`."""
    part = uuid.uuid4().hex
    _write_part(atlas, path, part)
    manifest = Manifest(atlas.spark, path)
    while True:
        version = manifest.read()[0] + 1
        if manifest.commit(version, {"version": VERSION, "qb": atlas.qb, "parts": [part]}):
            return version


def _snapshot(manifest: Manifest, version: int | None = None) -> tuple[int, dict]:
    number, snapshot = manifest.read(version)
    if not number:
        raise ValueError(f"there is no index at {manifest.path}")
    if snapshot["version"] != VERSION:
        raise ValueError(f"the index has version {snapshot['version']}, this library reads {VERSION}")
    return number, snapshot


def append(atlas: Atlas, path: str, name: str | None = None) -> int:
    """Add the index to that which the path holds, or begin one, and return the number of the snapshot. Only what is new is
    written; its types are checked against those stored. A name stands for the part: what is added again under it changes nothing,
    so a step that may be repeated has its effect once. Before the commit, and after a failure, readers see the index as it was."""
    spark, part = atlas.spark, name or uuid.uuid4().hex
    manifest = Manifest(spark, path)
    written = False
    while True:
        number, snapshot = manifest.read()
        if number:
            _, snapshot = _snapshot(manifest, number)
            if part in snapshot["parts"]:
                return number
            if snapshot["qb"] != atlas.qb:
                raise ValueError("indexes with different quantisation bits can't be merged")
            check_types_apart(_read(spark, path, snapshot["parts"], "cell_types").unionByName(atlas.cell_types))
        if not written:
            _write_part(atlas, path, part)
            written = True
        if manifest.commit(number + 1, {"version": VERSION, "qb": atlas.qb, "parts": [*snapshot.get("parts", []), part]}):
            return number + 1


def compact(spark: SparkSession, path: str) -> int:
    """Write the parts of an index as one, with all that is derived, and return the number of the snapshot."""
    manifest, part = Manifest(spark, path), uuid.uuid4().hex
    number, snapshot = _snapshot(manifest)
    whole = snapshot["parts"]
    _write_part(load(spark, path, number), path, part)
    while True:
        # parts that came meanwhile stay as they are
        number, snapshot = _snapshot(manifest)
        if snapshot["parts"][: len(whole)] != whole:
            raise ValueError("the index was replaced while it was compacted")
        if manifest.commit(number + 1, {**snapshot, "parts": [part, *snapshot["parts"][len(whole) :]]}):
            return number + 1


def expire(spark: SparkSession, path: str) -> None:
    """Drop all snapshots but the latest, and the parts that only those had."""
    manifest = Manifest(spark, path)
    number, snapshot = _snapshot(manifest)
    old = [v for v in manifest.versions() if v < number]
    parts = {p for v in old for p in manifest.read(v)[1]["parts"]} - set(snapshot["parts"])
    manifest.drop(old)
    for p in sorted(parts):
        manifest.drop_part(p, list(TABLES))


def _read(spark: SparkSession, path: str, parts: list[str], name: str) -> DataFrame:
    """A table of some parts."""
    files = spark.read.schema(f"{TABLES[name]}, part string").option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/part={p}" for p in parts])
    return files.drop("part")


def load(spark: SparkSession, path: str, version: int | None = None) -> Atlas:
    """The index that the path holds, or that of an earlier snapshot."""
    _, snapshot = _snapshot(Manifest(spark, path), version)
    e, c, t, s, g, b = (_read(spark, path, snapshot["parts"], name) for name in TABLES)
    return Atlas(e.select("dataset", "cell_type", "cell_id", "gene", "value"), c, t, snapshot["qb"], s, g if len(snapshot["parts"]) == 1 else added_genes(g), b, tasks=tasks_for(e))


def footprint(spark: SparkSession, path: str) -> DataFrame:
    """(name, files, bytes): what the tables of a saved index take on disk, all snapshots' parts together."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    name = F.regexp_extract("path", "/([a-z_]+)/part=[^/]*/", 1)
    return files.select(name.alias("name"), "length").groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def driver_atlas(spark: SparkSession, sf_dir: str, kind: str = "orders") -> Atlas:
    """`barcodes`: cells are parts that a region's customers bought, so every region's dataset has cells of the same names; genes are
    nations of suppliers. `orders`: sparse, cells are orders and genes brands. `customer`: dense, cells are customers. `classes`: the same with genes
    of eight classes of parts, so that most cells have most genes. `supplier`: cells are suppliers and genes part types,
    most of which every supplier has. `parts`: the same with genes of single parts, which few suppliers have."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    place = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("dataset"), F.col("n_name").alias("label")))
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # parts and customers grow with the tables too, so neither is broadcast by way of the driver
    sold = line.join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    n = max(tasks_for(line), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def of_orders(rows: DataFrame) -> DataFrame:
        """Sold lines with what their orders tell: both sides grow with the tables, so they meet in a shuffle and neither is sent to the driver."""
        return sold.repartition(n, "l_orderkey").join(rows.repartition(n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))

    if kind == "barcodes":
        nations = place.select(F.col("n_nationkey").alias("s_at"), F.col("label").alias("gene"))
        by = _table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("s_at")).select("s_suppkey", "gene")
        whose = orders.join(customer.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "dataset")
        long = of_orders(whose).join(by, F.col("l_suppkey") == F.col("s_suppkey"))
        return from_long(long.select("dataset", F.col("p_brand").alias("label"), F.col("l_partkey").alias("cell"), "gene", F.col("l_quantity").alias("value")))
    if kind == "orders":
        cells = orders.join(customer.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("cell"), F.col("c_nationkey").alias("at"))
        entries = sold.select(F.col("l_orderkey").alias("cell"), F.col("p_brand").alias("gene"), F.col("l_quantity").alias("value"))
    elif kind in ("customer", "classes"):
        gene = F.col("p_brand") if kind == "customer" else F.concat(F.lit("class"), (F.col("p_size") % 8).cast("string"))
        cells = customer.select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("at"))
        entries = of_orders(orders).select(F.col("o_custkey").alias("cell"), gene.alias("gene"), F.col("l_quantity").alias("value"))
    elif kind in ("supplier", "parts"):
        gene = F.col("p_type") if kind == "supplier" else F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
        cells = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("at"))
        entries = sold.select(F.col("l_suppkey").alias("cell"), gene.alias("gene"), F.col("l_quantity").alias("value"))
    else:
        raise ValueError(f"no atlas {kind!r}")
    return build(cells.join(place, F.col("at") == F.col("n_nationkey")).select("dataset", "label", "cell"), entries, write_cells=True)


def driver_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak names chrN_start_end, one for each part."""
    p = _table(spark, sf_dir, "part")
    start = F.col("p_partkey") * 100
    return p.select(F.concat_ws("_", F.concat(F.lit("chr"), F.col("p_size").cast("string")), start.cast("string"), (start + 50).cast("string")).alias("gene"))
