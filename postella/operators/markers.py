"""Genes as markers of cell types: precision, recall and F1 from supports alone."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.atlas import Atlas
from .boolean import find_query
from .lookup import resolve_genes
from ..plans.query import Query

SORT = ("cell_type", "gene", "tp", "fp", "fn", "precision", "recall", "f1")


def _metrics(df: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn, by way of their inverses: where a background that doesn't hold the target has
    nothing of a gene, tp + fp is 0 and precision infinite, as there is nothing false, and f1 is twice the recall. Without a
    true positive precision is 0, or null if there is no false one either; recall and f1 are null."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    precision = F.when((tp > 0) & (tp + fp == 0), F.lit(float("inf"))).otherwise(F.try_divide(tp, tp + fp))
    return df.withColumns({"precision": precision, "recall": F.try_divide(tp, tp + fn), "f1": F.when(tp > 0, 2 / (F.try_divide(tp + fp, tp) + F.try_divide(fn + tp, tp)))})


def score(atlas: Atlas, cell_types: list[str], background: list[str] | None = None, genes: list[str] | DataFrame | None = None) -> DataFrame:
    """A row for each gene that occurs in a target type, of those given where some are, as a list or a frame. The target counts are taken off the background's
    whether or not it is in there, so fp can be negative."""
    s = atlas.support
    if genes is not None:
        s = s.join(genes, "gene", "left_semi") if isinstance(genes, DataFrame) else s.where(F.col("gene").isin(genes))
    mine = s.where(F.col("cell_type").isin(cell_types)).join(atlas.cell_types.select("cell_type", "total_cells"), "cell_type")
    around = s if background is None else s.where(F.col("cell_type").isin(background))
    around = around.groupBy("gene").agg(F.sum("n_cells").alias("around"))
    rows = mine.join(around, "gene", "left").select("cell_type", "gene", F.col("n_cells").alias("tp"), (F.coalesce("around", F.lit(0)) - F.col("n_cells")).alias("fp"), (F.col("total_cells") - F.col("n_cells")).alias("fn"))
    return _metrics(rows)


def _sort_field(field: str) -> str:
    if field not in SORT:
        warnings.warn(f"no field {field!r}; f1 is used", stacklevel=3)
        return "f1"
    return field


def _asked(cell_types: list[str]) -> Column:
    """Where a row's type stands among those asked."""
    return F.array_position(F.array(*[F.lit(t) for t in cell_types]), F.col("cell_type"))


def top_markers(atlas: Atlas, cell_types: list[str], background: list[str] | None = None, top_k: int = 5, sort_field: str = "f1") -> DataFrame:
    """The best genes over all requested types together, ties in the order of types asked, then genes; what isn't defined comes last."""
    return score(atlas, cell_types, background).orderBy(F.col(_sort_field(sort_field)).desc_nulls_last(), _asked(cell_types), "gene").limit(top_k)


def evaluate(atlas: Atlas, genes: list[str] | DataFrame, cell_types: list[str], background: list[str] | None = None, sort_field: str = "f1") -> DataFrame:
    """Scores of the given genes, ascending, ties in the order of types asked, then genes; what isn't defined comes last. Very many
    genes are given as a frame with a column `gene`, which isn't read by the driver; unknown ones are left out."""
    if isinstance(genes, DataFrame):
        asked = genes.select(F.lower("gene").alias("lc"))
        known = atlas.genes.join(asked, "lc", "left_semi").groupBy("lc").agg(F.min("gene").alias("gene")).select("gene")
    else:
        known = list(dict.fromkeys(resolve_genes(atlas, genes).values()))
    return score(atlas, cell_types, background, known).orderBy(F.col(_sort_field(sort_field)).asc_nulls_last(), _asked(cell_types), "gene")


def evaluate_all(atlas: Atlas, genes: list[str], cell_types: list[str], background: list[str] | None = None) -> DataFrame:
    """The genes together as one marker: a cell has it if it has all of them. Only types of the background with such cells count."""
    known = list(dict.fromkeys(resolve_genes(atlas, genes).values()))
    hits = find_query(atlas, Query(required=known))
    if background is not None:
        hits = hits.where(F.col("cell_type").isin(background))
    hits = hits.groupBy("cell_type").agg(F.count("*").alias("n"))
    around = hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("around"))
    types = atlas.cell_types.where(F.col("cell_type").isin(cell_types)).select("cell_type", "total_cells")
    rows = types.join(hits, "cell_type", "left").join(F.broadcast(around))
    tp = F.coalesce("n", F.lit(0))
    rows = rows.select("cell_type", F.lit(",".join(known) + ",").alias("gene"), tp.alias("tp"), (F.col("around") - tp).alias("fp"), F.when(F.col("n").isNotNull(), F.col("total_cells") - tp).otherwise(F.lit(0)).alias("fn"))
    return _metrics(rows)
