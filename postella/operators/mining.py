"""Frequent gene sets of a query, ranked by tf-idf."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.atlas import Atlas
from ..sources.shared import written
from .bitmaps import KEY as BLOCK
from .bitmaps import SLICE, WHOLE, bitmaps_of
from .display import signif
from .lookup import query_genes, resolve_genes, scoped

KEY = ["dataset", "cell_type", "cell_id"]
#: Genes of which all sets are enumerated at most, as they are bits of a number.
MASK_GENES = 32


def tfidf(atlas: Atlas, genes: list[str], datasets: list[str] | None = None) -> DataFrame:
    """(gene, tfidf): a gene's share of reads summed over its cells, times (cells in the datasets) / (its cells anywhere)."""
    total = scoped(atlas, atlas.cell_types, datasets).agg(F.sum("total_cells").alias("__total"))
    e = query_genes(atlas, genes, datasets).join(scoped(atlas, atlas.cells, datasets).select(*KEY, "reads"), KEY)
    per = e.groupBy("gene").agg(F.sum(F.col("value") / F.col("reads")).alias("tf"))
    reads = atlas.genes.where(F.col("gene").isin(list(genes)))
    return per.join(reads, "gene").join(F.broadcast(total)).select("gene", (F.col("tf") * F.col("__total") / F.col("total_reads")).alias("tfidf"))


def cutoff_heuristic(atlas: Atlas, genes: list[str], datasets: list[str] | None = None, percentile: float = 0.5) -> DataFrame:
    """(cutoff): 1 for up to seven genes, else the percentile over genes of their cells' other genes, scaled by density."""
    e = query_genes(atlas, genes, datasets)
    g = len(dict.fromkeys(genes))
    if g <= 7:
        return atlas.spark.range(1).select(F.lit(1).cast("long").alias("cutoff"))
    sizes = e.groupBy(*KEY).agg(F.count("*").alias("k"))
    scale = sizes.agg(F.sum("k").alias("support"), F.count("*").alias("cells"))
    per = e.join(sizes, KEY).groupBy("gene").agg(F.floor(F.sum(F.col("k") - 1) / g).alias("c"))
    asked = atlas.spark.createDataFrame([(x,) for x in dict.fromkeys(genes)], "gene string")
    scaled = asked.join(per, "gene", "left").join(F.broadcast(scale)).select("gene", F.floor(F.coalesce("c", F.lit(0)) * (F.col("support") / F.col("cells") / F.log(F.lit(float(g))))).cast("long").alias("cutoff"))
    nth = Window.orderBy("cutoff", "gene")  # one row for each asked gene
    return scaled.withColumn("i", F.row_number().over(nth)).where(F.col("i") == min(int(g * percentile + 0.5), g - 1) + 1).select("cutoff")


def transactions(atlas: Atlas, genes: list[str], datasets: list[str] | None = None) -> DataFrame:
    """Cells with the asked genes that they have."""
    return query_genes(atlas, genes, datasets).groupBy(*KEY).agg(F.array_sort(F.collect_set("gene")).alias("items"))


def _all_sets(atlas: Atlas, genes: list[str], datasets: list[str] | None, cutoff: int) -> DataFrame:
    """(s, n_cells): sets of two or more genes, as bits of a number, that at least `cutoff` cells have together. A set's
    cells are bitmaps; those of a set and one more gene are their intersection, block by block, and their number the sum of its
    counts. Only frequent sets grow, each by later frequent genes, so every set is made once and none that a part of it rules out.
    A level is written to the shared folder, and goes when the next one is there."""
    number = F.element_at(F.create_map(*[x for i, g in enumerate(genes) for x in (F.lit(g), F.lit(1 << i).cast("long"))]), F.col("gene"))
    single = scoped(atlas, bitmaps_of(atlas), datasets).where(F.col("gene").isin(genes)).select(number.alias("s"), *BLOCK, F.expr(WHOLE).alias("bits"), "n")

    def frequent(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        counts = rows.groupBy("s").agg(F.sum("n").alias("n_cells")).where(F.col("n_cells") >= cutoff)
        return counts, rows.join(counts.select("s"), "s", "left_semi")

    def grown(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8) & np.frombuffer(b"".join(part.column("more").to_pylist()), np.uint8)
                n = np.bitwise_count(bits.reshape(part.num_rows, -1)).sum(axis=1, dtype=np.int64)
                keep = n > 0
                kept = [r.tobytes() for r in bits.reshape(part.num_rows, -1)[keep]]
                yield pa.RecordBatch.from_arrays([*[part.column(c).filter(pa.array(keep)) for c in ("s", *BLOCK)], pa.array(kept, pa.binary()), pa.array(n[keep])], names=["s", *BLOCK, "bits", "n"])

    now = written(frequent(single)[1], "sets")
    one = now.select(F.col("s").alias("g"), *BLOCK, F.col("bits").alias("more"))
    found = None
    for _ in range(1, len(genes)):
        pairs = now.join(one, BLOCK).where(F.col("g") > F.col("s")).select((F.col("s").bitwiseOR(F.col("g"))).alias("s"), *BLOCK, "bits", "more")
        level = written(pairs.mapInArrow(grown, single.schema), "sets")
        counts, now = frequent(level)
        counts = written(counts, "sets")
        if counts.isEmpty():
            break
        found = counts if found is None else found.union(counts)
    return found if found is not None else atlas.spark.createDataFrame([], "s long, n_cells long")


def frequent_sets(atlas: Atlas, genes: list[str], datasets: list[str] | None = None, cutoff: int = 1, exhaustive: bool = False) -> DataFrame:
    """(query, items, n_cells): sets of two or more genes that at least `cutoff` cells have together. With a cutoff of 0
    the exhaustive way gives every set, those of no cell too."""
    every = exhaustive and int(cutoff) <= 0
    cutoff = max(int(cutoff), 1)
    genes = sorted(dict.fromkeys(genes))
    if exhaustive:
        if len(genes) > MASK_GENES:
            raise ValueError(f"all sets are enumerated for up to {MASK_GENES} genes")
        found = _all_sets(atlas, genes, datasets, cutoff)
        if every:
            whole = atlas.spark.range(1, 1 << len(genes)).where("bit_count(id) > 1").withColumnRenamed("id", "s")
            found = whole.join(found, "s", "left").select("s", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))
        found = found.withColumn("__g", F.array(*[F.lit(g) for g in genes])).selectExpr("filter(__g, (g, i) -> shiftright(s, i) & 1 = 1) items", "n_cells")
    else:
        from pyspark.ml.fpm import FPGrowth

        # counted, and read by the fit: made once
        t = written(transactions(atlas, genes, datasets).where(F.size("items") > 1).select("items"), "transactions")
        n = t.count()
        if not n:
            return atlas.spark.createDataFrame([], "query string, items array<string>, n_cells long")
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (cutoff - 0.5) / n)).fit(t)
        found = model.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("items"), F.col("freq").alias("n_cells"))
    return found.select(F.array_join("items", ",").alias("query"), "items", "n_cells")


def marker_genes(atlas: Atlas, terms: list[str], datasets: list[str] | None = None, exhaustive: bool = False, support_cutoff: int = -1) -> DataFrame:
    """(n_genes, query, tfidf, n_cells): the query's frequent sub-queries; a set's score is the sum of its genes' scores times the least."""
    genes = sorted(dict.fromkeys(resolve_genes(atlas, terms).values()))
    cutoff = support_cutoff if support_cutoff >= 0 else cutoff_heuristic(atlas, genes, datasets).first().cutoff if genes else 1
    sets = frequent_sets(atlas, genes, datasets, cutoff, exhaustive)
    scored = sets.select("query", "n_cells", F.explode("items").alias("gene")).join(tfidf(atlas, genes, datasets), "gene")
    return scored.groupBy("query", "n_cells").agg(F.count("*").alias("n_genes"), (F.sum("tfidf") * F.min("tfidf")).alias("tfidf")).select("n_genes", "query", "tfidf", "n_cells")


def recommended_queries(atlas: Atlas, terms: list[str], datasets: list[str] | None) -> DataFrame:
    """What a front end offers: the sub-queries of more than one gene, some of them known, in one dataset or more, their scores to
    five digits; else nothing."""
    some = len(terms) > 1 and datasets and resolve_genes(atlas, terms)
    found = marker_genes(atlas, terms, datasets) if some else atlas.spark.createDataFrame([], "n_genes long, query string, tfidf double, n_cells long")
    return found.withColumn("tfidf", signif(F.col("tfidf"), 5))


def best_subquery(found: DataFrame) -> DataFrame:
    """(position, gene): the genes of the sub-query with the highest score."""
    best = found.orderBy(F.col("tfidf").desc(), "query").limit(1)
    return best.select(F.posexplode(F.split("query", ",")).alias("i", "gene")).select((F.col("i") + 1).cast("long").alias("position"), "gene")
