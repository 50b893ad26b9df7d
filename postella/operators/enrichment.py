"""Which cell types a query's cells are enriched in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import holm, with_hyper_tail
from ..plans.atlas import Atlas
from .boolean import find
from .lookup import scoped


def enrich(atlas: Atlas, hits: DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """(cell_type, cell_hits, total_cells, pval): hypergeometric P(X > hits) among the cells of the types that
    are hit, adjusted by Holm for the number of all types in the datasets. Beyond counting the hits, all
    is done on one row for each type."""
    per = hits.groupBy("cell_type").agg(F.count("*").alias("cell_hits"))
    types = scoped(atlas, atlas.cell_types, datasets).select("cell_type", "total_cells")
    n = types.agg(F.count("*").alias("__n"))
    every = Window.partitionBy()
    rows = per.join(types, "cell_type").withColumns({"__k": F.sum("cell_hits").over(every), "__u": F.sum("total_cells").over(every)})
    rows = with_hyper_tail(rows, "cell_hits", "total_cells", "__u", "__k", "pval").join(F.broadcast(n))
    return holm(rows, "pval", F.col("__n")).select("cell_type", "cell_hits", "total_cells", "pval")


def hyper_query(atlas: Atlas, terms: list[str], datasets: list[str] | None = None) -> DataFrame:
    return enrich(atlas, find(atlas, terms, datasets), datasets)
