"""Peaks within loci: names chrN_start_end against regions chrN:start-end."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_query


def regions(text: str) -> list[tuple[str, str, int, int]]:
    """(input, chromosome, start, end) of the loci in a query box, each once, in order; start must be below end."""
    out = {}
    for t in split_query(text):
        locus = t.lower().replace("_", ":", 1).replace("_", "-") if ":" not in t else t.lower().replace("_", "-")
        m = re.fullmatch(r"(chr[^:]*):(\d+)-(\d+)", locus)
        if m and int(m[2]) < int(m[3]):
            out.setdefault(locus, (locus, m[1], int(m[2]), int(m[3])))
    return list(out.values())


def parsed(peaks: DataFrame) -> DataFrame:
    """(gene, chromosome, p_start, p_end)."""
    return peaks.select("gene", F.regexp_extract("gene", r"^(.*?)_", 1).alias("chromosome"), F.regexp_extract("gene", r"_(\d+)_\d+$", 1).cast("long").alias("p_start"), F.regexp_extract("gene", r"_(\d+)$", 1).cast("long").alias("p_end"))


#: Bits of the narrowest bin; each further level's are eight times as wide. A region takes the level that cuts it into at most BINS or so.
BIN_BITS, LEVEL_BITS, BINS, LEVELS = 14, 3, 64, 16


def _binned(asked: DataFrame) -> DataFrame:
    """Regions with their level and one row for each bin of it that they reach."""
    width = F.col("q_end") - F.col("q_start")
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(F.shiftright(width, BIN_BITS + LEVEL_BITS * i) < BINS, F.lit(i)).otherwise(level)
    at = lambda c: F.call_function("shiftright", F.col(c), (F.lit(BIN_BITS) + LEVEL_BITS * F.col("level")).cast("int"))
    return asked.withColumn("level", level).withColumn("bin", F.explode(F.sequence(at("q_start"), at("q_end"))))


#: An array holds 2 to the TILE_BITS rows of one key at most. Rows of a task that makes arrays, and pairs of a task that opens them.
TILE_BITS, TASK_ROWS, TASK_PAIRS = 8, 1 << 18, 1 << 23
_KEY = ["chromosome", "level", "bin"]


def _tiles(rows: DataFrame, name: str, columns: list[str], least: str, most: str, tasks: int) -> DataFrame:
    """(chromosome, level, bin, tile of the name, its least and most, array of the name): the rows of a key in order of columns,
    a tile in an array. They are numbered where they stand, so no window is over a key; in order of all columns, a task that
    runs again makes the same arrays."""
    rows = rows.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY, *columns).withColumn(f"{name}_tile", F.call_function("shiftright", F.monotonically_increasing_id(), F.lit(TILE_BITS)))
    return rows.groupBy(*_KEY, f"{name}_tile").agg(F.min(least).alias(f"{name}_least"), F.max(most).alias(f"{name}_most"), F.collect_list(F.struct(*columns)).alias(name))


def peaks_in(peaks: DataFrame, asked: DataFrame) -> DataFrame:
    """(input, gene, chromosome, loc_1..loc_4): peaks inside regions (input, q_chromosome, q_start, q_end), of which there may
    be very many. A peak lies in the bin of its start at each level that regions have, a region reaches a few bins of its own level, and
    they meet by chromosome, level and bin: an equal join of arrays of rows, neither side of which is broadcast. Pairs of
    arrays are dealt to tasks by the number of their rows' pairs, which may be far more than the rows, and opened there."""
    binned = _binned(asked.where("q_start is not null and q_end is not null")).withColumnRenamed("q_chromosome", "chromosome")
    levels = sorted(r.level for r in binned.select("level").distinct().collect())
    p = parsed(peaks).where("p_start is not null and p_end is not null").withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels]).cast("array<int>")))
    p = p.withColumn("bin", F.call_function("shiftright", F.col("p_start"), (F.lit(BIN_BITS) + LEVEL_BITS * F.col("level")).cast("int")))
    rows = binned.select(*_KEY, F.lit(1).alias("n"), F.lit(0).alias("m")).union(p.select(*_KEY, F.lit(0), F.lit(1)))
    size = rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(F.col("n").cast("double") * F.col("m")).alias("pairs")).first()
    tasks = max(1, math.ceil(max(size.n or 0, size.m or 0) / TASK_ROWS))
    met = _tiles(binned, "asked", ["q_start", "q_end", "input"], "q_start", "q_end", tasks).join(_tiles(p, "peak", ["p_start", "p_end", "gene"], "p_end", "p_start", tasks).hint("merge"), _KEY)
    met = met.where((F.col("peak_most") >= F.col("asked_least")) & (F.col("peak_least") <= F.col("asked_most")))
    met = met.repartition(max(1, math.ceil((size.pairs or 0) / TASK_PAIRS)), *_KEY, "asked_tile", "peak_tile")
    pairs = met.select("chromosome", "peak", F.inline("asked")).select("input", "chromosome", "q_start", "q_end", F.inline("peak"))
    inside = pairs.where((F.col("p_start") >= F.col("q_start")) & (F.col("p_end") <= F.col("q_end")))
    return inside.select("input", "gene", "chromosome", F.col("q_start").alias("loc_1"), F.col("p_start").alias("loc_2"), F.col("p_end").alias("loc_3"), F.col("q_end").alias("loc_4"))


def peaks_within(peaks: DataFrame, text: str) -> DataFrame:
    """(input, gene, chromosome, loc_1..loc_4): peaks inside the regions of a query box. Nothing unless all names are peaks, as
    then the terms are plain genes."""
    asked = peaks.sparkSession.createDataFrame(regions(text), "input string, q_chromosome string, q_start long, q_end long")
    return peaks_in(peaks, asked) if all_peaks(peaks) else peaks_in(peaks.limit(0), asked)


def all_peaks(peaks: DataFrame) -> bool:
    """Whether every name starts with chr, which turns locus queries on."""
    return peaks.where(~F.col("gene").startswith("chr")).isEmpty()


def loci(peaks: DataFrame, text: str) -> DataFrame:
    """Peaks within regions with the gaps before, in and after them."""
    return with_gaps(peaks_within(peaks, text))


def with_gaps(found: DataFrame) -> DataFrame:
    return found.withColumns({"gap_before": F.col("loc_2") - F.col("loc_1"), "width": F.col("loc_3") - F.col("loc_2"), "gap_after": F.col("loc_4") - F.col("loc_3")})
