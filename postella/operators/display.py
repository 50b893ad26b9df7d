"""What a front end shows: folded marker strings, rounded values, embeddings with hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

KEY = ["dataset", "cell_type", "cell_id"]


def signif(x: Column, digits: int) -> Column:
    """Rounded to significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def fold_markers(scores: DataFrame, field: str = "f1") -> DataFrame:
    """(cell_type, markers): `gene : value` of each type in one string, in the order of genes."""
    pair = F.struct("gene", F.concat_ws(" : ", "gene", F.format_string("%.3f", F.col(field))).alias("s"))
    return scores.groupBy("cell_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["s"]), ", ").alias("markers"))


def neg_log10(p: Column) -> Column:
    return -F.log10(p)


def umap_hits(umap: DataFrame, hits: DataFrame, cell_types: list[str]) -> DataFrame:
    """Embedded cells of the types with a flag for the query's hits; a key stands once on either side."""
    mine = umap.where(F.col("cell_type").isin(cell_types))
    return mine.join(hits.select(*KEY, F.lit(True).alias("hit")), KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


#: Bits of a row's number in its partition, as monotonically_increasing_id has them.
ROW_BITS = 33


def in_order(df: DataFrame) -> DataFrame:
    """The rows of an ordered result with their places in it, from 1, as `position`. They are written once, in parts that follow each
    other; a part's rows are numbered on their own and shifted by the rows of the parts before, so no task has all of them."""
    parts = written(df.withColumn("__row", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftright("__row", ROW_BITS))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    shift = parts.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    nth = F.col("__row") - F.shiftleft("__part", ROW_BITS)
    return parts.join(F.broadcast(shift), "__part").withColumn("position", nth + F.col("__shift") + 1).drop("__row", "__part", "__shift")


def tagged_union(**results: DataFrame) -> DataFrame:
    """Results of several indexes in one frame, with the name of each as `tag`."""
    out = None
    for tag, df in results.items():
        one = df.withColumn("tag", F.lit(tag))
        out = one if out is None else out.unionByName(one)
    return out
