"""Importance resampling towards a target distribution: hashed word runs, gains by bucket, the highest noisy weights drawn.

Documents are scored by an array of integer gains, one for each bucket. Scores are integers, so their ranks come from a
histogram: counts summed from the highest score down, in digits of a few bits so that no sum runs over more than 2,048 rows,
give each score's first rank; the cutoff is the last score whose first rank is drawn. Only documents
from there on are numbered, by id within their score. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pick

#: What words don't hold: ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of a score's digit, and digits below the highest; equal rows that are numbered by one array.
DIGIT, DIGITS, STEP = 11, 3, 1 << 16
OUT = ["doc_id", "n_features", "weight", "score", "rank"]


def words_of(text: Column) -> Column:
    """Words of the text, ASCII letters in lower case; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _runs_of(w: Column, n: int) -> Column:
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))


def features_of(words: str, longest: int) -> Column:
    """All runs of up to `longest` words, each joined by one space."""
    w = F.col(words)
    return F.concat(w, *[_runs_of(w, n) for n in range(2, longest + 1)]) if longest > 1 else w


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(df: DataFrame, text_col: str, longest: int, buckets: int) -> list[int]:
    """Features of all texts by bucket: as many numbers as there are buckets."""
    f = pick(df, t=(text_col, "string")).select(words_of(F.col("t")).alias("w")).select(F.explode(features_of("w", longest)).alias("f"))
    out = [0] * buckets
    for r in f.groupBy(bucket_of(F.col("f"), buckets).alias("b")).agg(F.count("*").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """1000 times the log of how much more of the target than of the source is in each bucket, one added to each, rounded down."""
    m, s, t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((b + 1) * (s + m) / ((a + 1) * (t + m)))) for a, b in zip(source, target, strict=True)]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise from the id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, by_bucket: list[int], longest: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    # one literal of the plan, folded before it runs
    gain = F.split(F.lit(",".join(map(str, by_bucket))), ",").cast("array<bigint>")
    rows = pick(docs, doc_id=(id_col, "long"), t=(text_col, "string")).select("doc_id", words_of(F.col("t")).alias("w"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), features_of("w", longest).alias("f"))
    weight = F.aggregate("f", F.lit(0).cast("long"), lambda a, f: a + F.get(gain, bucket_of(f, len(by_bucket)).cast("int")))
    rows = rows.select("doc_id", "n_words", F.size("f").cast("long").alias("n_features"), weight.alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def rank_offsets(histogram: DataFrame) -> DataFrame:
    """(score, n, above): how many rows have a higher score, of a histogram (score, n). Sums run within a digit of the score
    at a time, lowest last: none is over more rows than a digit has values, but for the highest, whose values are few."""
    levels = [histogram.withColumn("up", F.shiftright("score", DIGIT))]
    for _ in range(DIGITS):
        levels.append(levels[-1].groupBy("up").agg(F.sum("n").alias("n")).withColumnRenamed("up", "score").withColumn("up", F.shiftright("score", DIGIT)))
    top = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("up").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = levels[-1].select("score", F.coalesce(F.sum("n").over(top), F.lit(0)).alias("above"))
    for level in levels[-2::-1]:
        mine = level.select("score", "n", "up", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("here"))
        above = mine.join(above.select(F.col("score").alias("up"), "above"), "up").select("score", "n", (F.col("here") + F.col("above")).alias("above"))
    return above


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: of those with `least_words` or more the `percent` in a
    hundred, rounded down, of highest score are ranked from 1, ties by the smaller id; the others' rank is null.

    A null or empty text has no words, weight 0, and isn't drawn. A null id takes its noise from the text `null` and comes
    before other ids. Rows that repeat an id have the same noise; ties among them go by n_features, then weight, and equal
    rows take ranks in a row: they are counted before they are numbered, so that no task has to sort them. Very long
    texts are one row's array of words. An empty table gives no rows, an empty target equal shares. Columns are
    taken by name, others don't matter."""
    by_bucket = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))
    rows = checkpoint(scored(docs, by_bucket, longest, seed, id_col, text_col))
    fit = F.col("n_words") >= least_words
    offsets = rank_offsets(rows.where(fit).groupBy("score").agg(F.count("*").alias("n")))
    n = rows.where(fit).count()
    drawn = percent * n // 100
    no_rank = F.lit(None).cast("long").alias("rank")
    first = offsets.where(F.col("above") < drawn)
    cutoff = first.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.select(*OUT[:-1], no_rank)
    high = fit & (F.col("score") >= cutoff)
    alike = rows.where(high).groupBy(*OUT[:-1]).agg(F.count("*").alias("n"))
    before = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.join(first.select("score", "above"), "score").withColumn("first", F.col("above") + F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)
    # in steps, so that no array grows with the number of equal rows
    last = F.col("first") + F.col("n") - 1
    steps = placed.select(*OUT[:-1], last.alias("last"), F.explode(F.sequence("first", last, F.lit(STEP))).alias("from"))
    each = steps.select(*OUT[:-1], F.explode(F.sequence("from", F.least(F.col("from") + STEP - 1, F.col("last")))).alias("rank"))
    ranked = each.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return rows.where(~high).select(*OUT[:-1], no_rank).unionByName(ranked.select(*OUT))
