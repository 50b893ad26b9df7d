"""Scans, lookups and counts over the index."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.atlas import Atlas


def select_datasets(atlas: Atlas, datasets: list[str] | None) -> list[str]:
    """The named datasets, or all; an unknown one is an error."""
    have = atlas.datasets()
    if datasets is None:
        return have
    if unknown := [d for d in datasets if d not in have]:
        raise ValueError(f"unknown datasets {unknown}; there are {have}")
    return list(datasets)


def scoped(atlas: Atlas, df: DataFrame, datasets: list[str] | None) -> DataFrame:
    """Rows of the datasets, of all where none is named; an unknown one is an error."""
    return df if datasets is None else df.where(F.col("dataset").isin(select_datasets(atlas, datasets)))


def gene_names(atlas: Atlas) -> DataFrame:
    return atlas.genes.select("gene").orderBy("gene")


def resolve_genes(atlas: Atlas, names: list[str]) -> dict[str, str]:
    """Asked names to the index's, whatever their case; of several the first in byte order. Only rows of the
    asked names come to the driver."""
    if not names:
        return {}
    asked = sorted({n.lower() for n in names})
    found = {r.lc: r.gene for r in atlas.genes.where(F.col("lc").isin(asked)).groupBy("lc").agg(F.min("gene").alias("gene")).collect()}
    if unknown := sorted({n for n in names if n.lower() not in found}):
        warnings.warn(f"ignoring unknown genes: {', '.join(unknown)}", stacklevel=3)
    return {n: found[n.lower()] for n in names if n.lower() in found}


def case_correct(atlas: Atlas, names: list[str]) -> DataFrame:
    """(position, gene): resolved names in the order asked, each once. The asked list is a local relation, small by nature."""
    spark = atlas.spark
    asked = spark.createDataFrame([(i, n.lower()) for i, n in enumerate(names)], "i long, lc string")
    by = atlas.genes.where(F.col("lc").isin([n.lower() for n in names])).groupBy("lc").agg(F.min("gene").alias("gene"))
    first = by.join(F.broadcast(asked), "lc").groupBy("gene").agg(F.min("i").alias("i"))
    return first.selectExpr("i + 1 as position", "gene")


def cell_type_names(atlas: Atlas, datasets: list[str] | None = None) -> DataFrame:
    return scoped(atlas, atlas.cell_types, datasets).select("cell_type", "dataset", "label")


def query_genes(atlas: Atlas, genes: list[str], datasets: list[str] | None = None) -> DataFrame:
    """All entries of any of the genes."""
    return scoped(atlas, atlas.expression, datasets).where(F.col("gene").isin(list(genes)))


def entry_of(atlas: Atlas, gene: str, cell_type: str) -> DataFrame:
    """Cells of one posting."""
    return atlas.expression.where((F.col("gene") == gene) & (F.col("cell_type") == cell_type)).select("cell_id", "value")


#: An array holds the cell ids of one block, at most 2^LIST_BITS; smaller types are one block.
LIST_BITS = 20


def in_blocks(cells: DataFrame, *by: str) -> DataFrame:
    """(by, block, cell_ids): sorted arrays of cell ids, of which none grows with its group beyond a block."""
    return cells.groupBy(*by, F.shiftright("cell_id", LIST_BITS).alias("block")).agg(F.sort_array(F.collect_list("cell_id")).alias("cell_ids"))


def posting_lists(atlas: Atlas) -> DataFrame:
    """Postings with sorted cell ids, in blocks, their number and log2(total / n) as idf; arrays are made on demand,
    queries don't need them."""
    n = atlas.support.select("gene", "cell_type", "n_cells").join(atlas.cell_types.select("cell_type", "total_cells"), "cell_type")
    p = in_blocks(atlas.expression, "gene", "cell_type").join(n, ["gene", "cell_type"])
    return p.select("gene", "cell_type", "block", "cell_ids", "n_cells", F.log2(F.col("total_cells") / F.col("n_cells")).alias("idf"))


#: Postings of which the i-th is found by sorting them.
SORTED = 1 << 14


def posting_key(atlas: Atlas, i: int, most: int = SORTED) -> DataFrame:
    """(gene, cell_type): the i-th posting from 0 in the order of genes and types, none if there is none. Names are
    counted by the two bytes that follow what all of them begin with, which tells the part of them that has the i-th, and so on in
    that part until it is small: no task holds or sorts the postings before it, and the driver sees a count for each two bytes."""
    keys = atlas.support.select("gene", "cell_type", F.hex(F.concat_ws("\0", "gene", "cell_type").cast("binary")).alias("k"))
    while i >= 0:
        low, high, n = keys.agg(F.min("k"), F.max("k"), F.count("*")).first()
        if i >= n:
            break
        if n <= most:
            return keys.orderBy("gene", "cell_type").offset(i).limit(1).select("gene", "cell_type")
        same = len(os.path.commonprefix([low, high])) // 2 * 2
        part = F.substring("k", same + 1, 4)
        for r in keys.groupBy(part.alias("d")).count().orderBy("d").collect():
            if i < r["count"]:
                keys = keys.where(part == r.d)
                break
            i -= r["count"]
    return keys.select("gene", "cell_type").limit(0)


def posting_at(atlas: Atlas, i: int) -> DataFrame:
    """(gene, cell_type, cell_id, value) of the i-th posting from 0 in the order of genes and types; nothing if there is none."""
    one = posting_key(atlas, i)
    return atlas.expression.join(F.broadcast(one), ["gene", "cell_type"]).select("gene", "cell_type", "cell_id", "value")


def known_types(atlas: Atlas, universe: list[str]) -> DataFrame:
    """(cell_type, known): which of the asked types the index has."""
    asked = atlas.spark.createDataFrame([(t,) for t in dict.fromkeys(universe)], "cell_type string")
    return asked.join(atlas.cell_types.select("cell_type", F.lit(True).alias("known")), "cell_type", "left").select("cell_type", F.coalesce("known", F.lit(False)).alias("known"))


def cell_meta(atlas: Atlas, cell_type: str | None = None, cell_id: int | None = None) -> DataFrame:
    out = atlas.cells
    if cell_type is not None:
        out = out.where(F.col("cell_type") == cell_type)
    return out if cell_id is None else out.where(F.col("cell_id") == cell_id)


def gene_support(atlas: Atlas, genes: list[str], datasets: list[str] | None = None) -> DataFrame:
    """(gene, n_cells) for every asked gene, 0 where it has no cells."""
    asked = atlas.spark.createDataFrame([(g,) for g in dict.fromkeys(genes)], "gene string")
    n = scoped(atlas, atlas.support, datasets).where(F.col("gene").isin(list(genes))).groupBy("gene").agg(F.sum("n_cells").alias("n_cells"))
    return asked.join(n, "gene", "left").select("gene", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


def gene_support_by_type(atlas: Atlas, genes: list[str], datasets: list[str] | None = None) -> DataFrame:
    return scoped(atlas, atlas.support, datasets).where(F.col("gene").isin(list(genes))).select("gene", "cell_type", "n_cells")


def zero_support_genes(atlas: Atlas, datasets: list[str]) -> DataFrame:
    """Genes that have no cell in the datasets."""
    return atlas.genes.join(scoped(atlas, atlas.support, datasets).select("gene"), "gene", "left_anti").select("gene")


def zero_support_count(atlas: Atlas, datasets: list[str]) -> DataFrame:
    """(n_genes): how many genes have no cell in the datasets."""
    return zero_support_genes(atlas, datasets).agg(F.count("*").alias("n_genes"))


def total_cells(atlas: Atlas, datasets: list[str] | None = None) -> DataFrame:
    return scoped(atlas, atlas.cell_types, datasets).agg(F.coalesce(F.sum("total_cells"), F.lit(0)).alias("total_cells"), F.count("*").alias("n_cell_types"))


def cell_type_support(atlas: Atlas, cell_types: list[str]) -> DataFrame:
    """(position, cell_type, total_cells) as asked, repeats kept; 0 for an unknown type."""
    asked = atlas.spark.createDataFrame(list(enumerate(cell_types, 1)), "position long, cell_type string")
    return asked.join(atlas.cell_types.select("cell_type", "total_cells"), "cell_type", "left").select("position", "cell_type", F.coalesce("total_cells", F.lit(0)).alias("total_cells"))


def cells_in_index(atlas: Atlas) -> DataFrame:
    """(n_cells, n_genes, n_postings): how much the index holds."""
    cells = atlas.cell_types.agg(F.coalesce(F.sum("total_cells"), F.lit(0)).alias("n_cells"))
    genes = atlas.genes.agg(F.count("*").alias("n_genes"))
    postings = atlas.support.agg(F.count("*").alias("n_postings"))
    return cells.join(F.broadcast(genes)).join(F.broadcast(postings))  # one row each


def memory_footprint(atlas: Atlas) -> DataFrame:
    """(postings, bytes): what a bit-packed index of the same content would take: low and unary high bits,
    quantised values, and a fixed overhead for each posting."""
    p = atlas.expression.groupBy("gene", "cell_type").agg(F.count("*").alias("n"), F.max("cell_id").alias("last")).join(atlas.cell_types.select("cell_type", "total_cells"), "cell_type")
    low = F.floor(F.log2(F.col("total_cells") / F.col("n")) + 0.5) + 1
    p = p.withColumn("l", low).selectExpr("n", "cast(floor((cast(floor(last / power(2, l)) as bigint) + n) / 8) + 1 as bigint) h", "cast(floor(l * n / 8) + 1 as bigint) low", f"cast(floor(n * {atlas.qb} / 8) + 12 as bigint) q")
    return p.agg(F.count("*").alias("postings"), F.sum(F.col("h") + F.col("low") + F.col("q") + 32).alias("bytes"))
