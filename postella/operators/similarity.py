"""Genes whose cells are most like a query's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.atlas import Atlas
from ..plans.query import parse
from .bitmaps import KEY, find_blocks, overlaps
from .boolean import find
from .lookup import resolve_genes, scoped

OUT = "gene string, jaccard double, overlap long, n long"


def _jaccard(overlap: Column) -> Column:
    return overlap / (F.col("size") + F.col("n") - overlap)


def similar_genes(atlas: Atlas, terms: list[str], datasets: list[str] | None = None, top_k: int = 5) -> DataFrame:
    """(gene, jaccard, overlap, n), the top_k most similar in ascending order, of ties the later names; genes asked by their bare
    names are left out. An index with bitmaps is asked by bounds, another by one aggregation over the entries of the hits."""
    best = _by_bounds(atlas, terms, datasets, top_k) if atlas.bitmaps is not None else _by_entries(atlas, terms, datasets, top_k)
    return best.orderBy("jaccard", "gene")


def _asked(atlas: Atlas, terms: list[str]) -> list[str]:
    return list(resolve_genes(atlas, [t for t in terms if not t.startswith(("*", "-"))]).values())


def _by_entries(atlas: Atlas, terms: list[str], datasets: list[str] | None, top_k: int) -> DataFrame:
    """Supports tell n; of the entries only those of the hits are counted."""
    key = ["dataset", "cell_type", "cell_id"]
    hits = find(atlas, terms, datasets)
    size = hits.agg(F.count("*").alias("size"))
    asked = _asked(atlas, terms)
    others = ~F.col("gene").isin(asked) if asked else F.lit(True)
    entries = scoped(atlas, atlas.expression, datasets).select(*key, "gene").where(others)
    met = entries.join(hits, key).groupBy("gene").agg(F.count("*").alias("overlap"))
    n = scoped(atlas, atlas.support, datasets).where(others).groupBy("gene").agg(F.sum("n_cells").alias("n"))
    per = n.join(met, "gene", "left").fillna(0, ["overlap"]).join(F.broadcast(size))
    return per.select("gene", _jaccard(F.col("overlap")).alias("jaccard"), "overlap", "n").orderBy(F.col("jaccard").desc(), F.col("gene").desc()).limit(top_k)


def _by_bounds(atlas: Atlas, terms: list[str], datasets: list[str] | None, top_k: int) -> DataFrame:
    """A gene can share no more cells with the hits, block by block, than either has there. That bound needs counts alone, no
    bitmap. The genes of the highest bounds are counted first; those whose bound is below the least of the top_k found so are
    never read, the others are counted exactly."""
    q = parse(list(terms), lambda names: resolve_genes(atlas, names))
    every = scoped(atlas, atlas.bitmaps, datasets)
    if not q.genes or top_k < 1:  # no hits, which share nothing with any gene
        return _by_entries(atlas, terms, datasets, top_k)
    hits = find_blocks(every, scoped(atlas, atlas.cell_types, datasets), q).persist()
    asked = _asked(atlas, terms)
    others = every.where(~F.col("gene").isin(asked)) if asked else every
    size = hits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("size")).first().size
    with_size = lambda df: df.withColumn("size", F.lit(size))
    met = others.select("gene", *KEY, "n").join(hits.select(*KEY, F.bitmap_count("bits").alias("h")), KEY).groupBy("gene").agg(F.sum(F.least("n", "h")).alias("most"))
    n = others.groupBy("gene").agg(F.sum("n").alias("n"))
    per = with_size(n.join(met, "gene", "left").fillna(0, ["most"])).withColumn("bound", _jaccard(F.col("most"))).persist()

    def counted(genes: DataFrame) -> DataFrame:
        read = others.join(genes.select("gene"), "gene", "left_semi")
        return genes.join(overlaps(read, hits), "gene", "left").fillna(0, ["overlap"]).select("gene", _jaccard(F.col("overlap")).alias("jaccard"), "overlap", "n")

    first = [r.gene for r in per.orderBy(F.desc("bound"), F.desc("gene")).select("gene").limit(top_k).collect()]
    least = counted(per.where(F.col("gene").isin(first))).agg(F.min("jaccard")).first()[0]
    rows = counted(per.where(F.col("bound") >= F.lit(least)) if len(first) == top_k else per)
    best = rows.orderBy(F.col("jaccard").desc(), F.col("gene").desc()).limit(top_k).collect()
    hits.unpersist()
    per.unpersist()
    return atlas.spark.createDataFrame(best, OUT).coalesce(1)
