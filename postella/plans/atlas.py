"""The index: expression entries, cells, cell types, genes and supports, as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import tasks_for, written

VERSION = 2


@dataclass
class Atlas:
    """expression(dataset, cell_type, cell_id, gene, value), positive values only; cells(dataset, cell_type,
    cell_id, reads, features), cells without any value included; cell_types(cell_type, dataset, label,
    total_cells). Beside them stand what is derived from the entries and only ever added to, so that a saved index needn't
    read them again: supports(gene, cell_type, dataset, n_cells), names(gene, lc, total_reads) with the lower-case key that
    names are looked up by, and bitmaps(gene, cell_type, dataset, block, bits, n) of the cells that have a gene. An index that
    has none of these makes them from its entries."""

    expression: DataFrame
    cells: DataFrame
    cell_types: DataFrame
    qb: int = 2
    supports: DataFrame | None = None
    names: DataFrame | None = None
    bitmaps: DataFrame | None = None
    numbered: DataFrame | None = None
    counted: Callable[[DataFrame], DataFrame] | None = None
    tasks: int | None = None

    def __post_init__(self) -> None:
        check_bits(self.qb)
        self._datasets: list[str] | None = None

    @property
    def spark(self):
        return self.expression.sparkSession

    @property
    def support(self) -> DataFrame:
        """(gene, cell_type, dataset, n_cells), as small as genes times types: what counts can answer reads this."""
        if self.supports is None:
            self.supports = self.expression.groupBy("gene", "cell_type", "dataset").agg(F.count("*").alias("n_cells"))
        return self.supports

    @property
    def genes(self) -> DataFrame:
        """(gene, lc, total_reads): genes, their names in lower case, and the number of their expressing cells."""
        if self.names is None:
            self.names = self.support.groupBy("gene").agg(F.sum("n_cells").alias("total_reads")).select("gene", F.lower("gene").alias("lc"), "total_reads")
        return self.names

    def persist(self) -> Atlas:
        """Keep the tables for many queries; the entries stand in order of genes, so filters skip batches. Cells are counted from the
        entries that are kept, so that what they come from is read and summed once."""
        self.cell_types = self.cell_types.persist()
        if self.numbered is not None:
            self.numbered = self.numbered.persist()
        self.expression = self.expression.sortWithinPartitions("gene").persist()
        if self.counted is not None:
            self.cells = self.counted(self.expression)
        self.cells = self.cells.persist()
        if self.bitmaps is None:  # an index from files keeps what is stored there
            self.supports = self.names = None
        self.supports = self.support.persist()
        self.names = self.genes.persist()
        return self

    def unpersist(self) -> None:
        for t in (self.names, self.supports, self.cells, self.expression, self.numbered, self.cell_types):
            if t is not None:
                t.unpersist()

    def datasets(self) -> list[str]:
        """Names of the datasets, looked up once."""
        if self._datasets is None:
            self._datasets = [r.dataset for r in self.cell_types.select("dataset").distinct().orderBy("dataset").collect()]
        return list(self._datasets)


def check_bits(qb: int) -> int:
    """Bits of quantised values: below 32."""
    if not isinstance(qb, int) or not 0 < qb < 32:
        raise ValueError(f"quantisation bits must be from 1 to 31: {qb!r}")
    return qb


def check_dataset_name(name: str) -> str:
    if not name or "." in name:
        raise ValueError(f"a dataset's name must not be empty or hold a dot: {name!r}")
    return name


#: Keys in a numbering block; blocks of a type are numbered apart and shifted by the cells before them.
BLOCK_BITS = 20


def key_block(annotation: DataFrame, key: str) -> Column:
    """A number that ascends with the key, and of which there is about one for every 2^BLOCK_BITS keys if they are spread
    evenly. Strings count by the seven bytes that follow what all of them begin with; so they are read once before."""
    kind = dict(annotation.dtypes)[key]
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return F.shiftright(F.col(key).cast("long"), BLOCK_BITS)
    if kind != "string":
        return F.lit(0)
    low, high, n = annotation.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return F.lit(0)
    same = len(os.path.commonprefix([low.encode(), high.encode()]))
    number = F.conv(F.rpad(F.hex(F.substring(F.col(key).cast("binary"), same + 1, 7)), 14, "0"), 16, 10).cast("long")
    first, last = (int.from_bytes(x.encode()[same : same + 7].ljust(7, b"\0"), "big") for x in (low, high))
    return F.shiftright(number - first, max(0, (last - first).bit_length() - (n >> BLOCK_BITS).bit_length()))


def number_cells(annotation: DataFrame, key: str, block: Column | None = None, tasks: int | None = None) -> DataFrame:
    """cell_id: a cell's position from 1 in its type, in the order of the key. Keys are cut into
    blocks, so that a type with a great part of all cells is numbered by many tasks, of which there may be more the more cells."""
    if block is None:
        block = key_block(annotation, key)
    cut = annotation.withColumn("__b", block)
    before = Window.partitionBy("cell_type").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut.groupBy("cell_type", "__b").agg(F.count("*").alias("__n")).select("cell_type", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    nth = F.row_number().over(Window.partitionBy("cell_type", "__b").orderBy(key))
    dealt = cut.repartition(tasks, "cell_type", "__b") if tasks else cut
    return dealt.withColumn("__nth", nth).join(shift, ["cell_type", "__b"]).withColumn("cell_id", (F.col("__nth") + F.col("__shift")).cast("long")).drop("__b", "__nth", "__shift")


def _check_annotation(annotation: DataFrame, by: list[str], tasks: int) -> None:
    """Datasets need plain names, and a cell's key must stand once."""
    if bad := annotation.where("dataset is null or dataset = '' or contains(dataset, '.')").select("dataset").limit(1).collect():
        check_dataset_name(bad[0].dataset)
    if twice := annotation.select(*by).repartition(tasks, *by).groupBy(*by).count().where("count > 1").limit(1).collect():
        of = ", ".join(str(twice[0][c]) for c in by)
        raise ValueError(f"cell {of} stands more than once" + ("" if "dataset" in by else "; entries need a column `dataset` where cells of several datasets share names"))


def build(annotation: DataFrame, entries: DataFrame, qb: int = 2, least_cells: int = 2, write_cells: bool = False) -> Atlas:
    """annotation(dataset, label, cell, ...) has a row for each cell; entries(dataset, cell, gene, value) one for each
    measured value, whose repeats are summed. Datasets name their cells apart: a cell is known by dataset and name. Entries
    without a column `dataset` are those of the cell's only dataset. A cell that stands twice is an error. Types of fewer than
    `least_cells` cells are left out. Cells are checked, counted and numbered apart; with `write_cells` the annotation is written to
    the shared folder first, so that what it comes from is read once."""
    if write_cells:
        annotation = written(annotation, "cells")
    by = ["dataset", "cell"] if "dataset" in entries.columns else ["cell"]
    tasks = tasks_for(annotation, entries)
    n = max(tasks, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    _check_annotation(annotation, by, n)
    named = annotation.select("dataset", "label", "cell", F.concat_ws(".", "dataset", "label").alias("cell_type"))
    types = named.groupBy("cell_type", "dataset", "label").agg(F.count("*").alias("total_cells")).where(F.col("total_cells") >= least_cells)
    kept = number_cells(named.join(types.select("cell_type"), "cell_type", "left_semi"), "cell", tasks=n)
    dealt = entries.where("value is not null").repartition(n, *by)
    summed = dealt.groupBy(*by, "gene").agg(F.sum("value").cast("double").alias("value")).where("value > 0")
    expression = summed.join(kept.hint("merge"), by).select("dataset", "cell_type", "cell_id", "gene", "value")

    def counted(expression: DataFrame) -> DataFrame:
        """Every cell counts as a row of nothing, so sums tell those without values too."""
        key = ["dataset", "cell_type", "cell_id"]
        none = kept.select(*key, F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n"))
        return none.union(expression.select(*key, "value", F.lit(1).cast("long").alias("n"))).groupBy(*key).agg(F.sum("value").alias("reads"), F.sum("n").alias("features"))

    return Atlas(expression, counted(expression), types, qb, numbered=kept, counted=counted, tasks=tasks)


def added_genes(names: DataFrame) -> DataFrame:
    """Genes of several indexes as those of one: their counts are added."""
    return names.groupBy("gene", "lc").agg(F.sum("total_reads").alias("total_reads")).select("gene", "lc", "total_reads")


def check_types_apart(types: DataFrame) -> None:
    """No type may come from more than one index; found by a count over the small tables."""
    if clash := types.groupBy("cell_type").count().where("count > 1").select("cell_type").orderBy("cell_type").limit(5).collect():
        raise ValueError(f"cell types in more than one index: {', '.join(r.cell_type for r in clash)}")


def merge(*atlases: Atlas) -> Atlas:
    """One index of several. Equal type names or different quantisation are errors. What is derived from the entries is
    put together from what each index has, not made again."""
    first = atlases[0]
    if any(a.qb != first.qb for a in atlases):
        raise ValueError("indexes with different quantisation bits can't be merged")

    def together(name: str) -> DataFrame | None:
        tables = [getattr(a, name) for a in atlases]
        return None if any(t is None for t in tables) else reduce(DataFrame.unionByName, tables)

    types = together("cell_types")
    check_types_apart(types)
    bitmaps = together("bitmaps")
    tasks = None if any(a.tasks is None for a in atlases) else sum(a.tasks for a in atlases)
    return Atlas(together("expression"), together("cells"), types, first.qb, together("support"), added_genes(together("genes")), bitmaps, tasks=tasks)
