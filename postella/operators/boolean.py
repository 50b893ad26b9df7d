"""Boolean queries over cells, in one aggregation: of bitmaps where the index has them, else of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.atlas import Atlas
from ..plans.query import Query, parse
from .bitmaps import find_blocks, unpack
from .lookup import in_blocks, resolve_genes, scoped


def find(atlas: Atlas, terms: list[str], datasets: list[str] | None = None) -> DataFrame:
    """(dataset, cell_type, cell_id) of the cells that satisfy the terms."""
    return find_query(atlas, parse(list(terms), lambda names: resolve_genes(atlas, names)), datasets)


def find_query(atlas: Atlas, q: Query, datasets: list[str] | None = None) -> DataFrame:
    """All set algebra is counting a cell's genes by role: it needs all that are required and one of the
    alternatives, and must not have all excluded ones (and one of the excluded alternatives). Only
    a query of exclusions alone reads the cells that have none of the genes. Bitmaps, where the index has them, are
    read instead of entries, and tell those cells too."""
    key = ["dataset", "cell_type", "cell_id"]
    if not q.genes:
        return scoped(atlas, atlas.cells, datasets).select(*key).limit(0)
    if atlas.bitmaps is not None:
        return unpack(find_blocks(scoped(atlas, atlas.bitmaps, datasets), scoped(atlas, atlas.cell_types, datasets), q))
    entries = scoped(atlas, atlas.expression, datasets).where(F.col("gene").isin(q.genes))

    def n(genes: list[str]):
        return F.count_if(F.col("gene").isin(genes)) if genes else F.lit(0)

    found = entries.groupBy(*key).agg(n(q.required).alias("p"), n(q.any_of).alias("o"), n(q.excluded).alias("x"), n(q.excluded_any).alias("xo"))
    if q.only_excludes:
        found = scoped(atlas, atlas.cells, datasets).select(*key).join(found, key, "left").fillna(0, ["p", "o", "x", "xo"])
    keep = F.col("p") == len(q.required)
    if q.any_of:
        keep &= F.col("o") >= 1
    if q.excluded_any:
        keep &= ~((F.col("x") == len(q.excluded)) & (F.col("xo") >= 1))
    elif q.excluded:
        keep &= F.col("x") < len(q.excluded)
    return found.where(keep).select(*key)


def contingency_table(hits: DataFrame) -> DataFrame:
    """(cell_type, n_cells): how many hits each type has."""
    return hits.groupBy("cell_type").agg(F.count("*").alias("n_cells"))


def cells_by_type(hits: DataFrame) -> DataFrame:
    """Hits as sorted arrays of cell ids for each type, in blocks."""
    return in_blocks(hits, "cell_type")
