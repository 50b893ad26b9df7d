"""Postings as bitmaps: of each gene, type and block of 32,768 cells the cells that have the gene, as bits.

Blocks and bits are numbered as Spark's bitmap functions do; its aggregates make them, intersect and unite them. What
they don't have, differences and unpacking, is done on Arrow batches, a few hundred blocks at a time. Cell ids are unpacked only for output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.atlas import Atlas
from ..plans.query import Query

#: Bytes and bits of a block, as Spark's bitmap functions have them.
BYTES = 4096
BITS = 8 * BYTES
#: Blocks that are opened at once.
SLICE = 256
KEY = ["dataset", "cell_type", "block"]
_BLOCKS = "dataset string, cell_type string, block long, bits binary"


#: Mean number of cells of a posting below which its entries are shuffled rather than bitmaps of them.
THIN = 256
#: A bitmap of which the zeros at the end are left out, as long as others.
WHOLE = f"rpad(bits, {BYTES}, X'00')"


def of_entries(expression: DataFrame, dealt: int | None = None) -> DataFrame:
    """(gene, cell_type, dataset, block, bits, n) of entries; the zeros after the last cell are left out, so a posting of a type
    with few cells takes few bytes. Where genes are in few cells a bitmap takes more than they do, so their entries are
    `dealt` to so many tasks first; else each task makes bitmaps of what it reads."""
    blocks = expression.select("gene", "cell_type", "dataset", F.bitmap_bucket_number("cell_id").alias("block"), F.bitmap_bit_position("cell_id").alias("at"))
    key = ["gene", "cell_type", "dataset", "block"]
    if dealt:
        blocks = blocks.repartition(dealt, *key)
    made = blocks.groupBy(*key).agg(F.bitmap_construct_agg("at").alias("bits"), F.max("at").alias("last"), F.count("*").alias("n"))
    return made.select(*key, F.expr("substring(bits, 1, cast(last div 8 as int) + 1)").alias("bits"), "n")


def of_ordered(entries: DataFrame, dealt: int) -> DataFrame:
    """As `of_entries`, of entries that stand in the order of genes, types and cells, as a saved index has them. Bitmaps are made
    of runs, batch by batch, so no task sorts what it reads; those that a batch's end cuts are united in so many tasks."""
    key = ["gene", "cell_type", "dataset", "block"]
    rows = entries.select("gene", "cell_type", "dataset", F.bitmap_bucket_number("cell_id").alias("block"), F.bitmap_bit_position("cell_id").cast("int").alias("at"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("at").to_numpy()
            new = np.arange(b.num_rows) == 0
            for c in key:
                column = b.column(c)
                new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            row, n, last = np.cumsum(new) - 1, np.diff(first, append=b.num_rows), np.maximum.reduceat(at, first)
            for i in range(0, len(first), SLICE):
                some = first[i : i + SLICE]
                span = slice(some[0], some[-1] + n[i + len(some) - 1])
                bits = np.zeros((len(some), BYTES), np.uint8)
                np.bitwise_or.at(bits, (row[span] - i, at[span] >> 3), np.left_shift(1, at[span] & 7).astype(np.uint8))
                cut = [x[: end // 8 + 1].tobytes() for x, end in zip(bits, last[i : i + SLICE])]
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in key], pa.array(cut, pa.binary()), pa.array(last[i : i + SLICE], pa.int32()), pa.array(n[i : i + SLICE], pa.int64())], names=[*key, "bits", "last", "n"])

    made = rows.mapInArrow(run, "gene string, cell_type string, dataset string, block long, bits binary, last int, n long").repartition(dealt, *key)
    whole = made.groupBy(*key).agg(F.bitmap_or_agg(F.expr(WHOLE)).alias("bits"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return whole.select(*key, F.expr("substring(bits, 1, cast(last div 8 as int) + 1)").alias("bits"), "n")


def _matrix(column: pa.Array) -> np.ndarray:
    """Bitmaps as rows of bytes; null as zeros, as what is left out at an end."""
    return np.frombuffer(b"".join([(v or b"").ljust(BYTES, b"\0") for v in column.to_pylist()]), np.uint8).reshape(-1, BYTES)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * BYTES
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _all_cells(types: DataFrame) -> DataFrame:
    """(dataset, cell_type, block, cells): the blocks of types, and how many cells of each there are. Cells are
    numbered from 1 on, so their total tells all of them."""
    blocks = types.select("dataset", "cell_type", "total_cells", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("total_cells") / BITS))).alias("block"))
    return blocks.select(*KEY, F.least(F.lit(BITS), F.col("total_cells") - (F.col("block") - 1) * BITS).cast("int").alias("cells"))


def find_blocks(bitmaps: DataFrame, types: DataFrame, q: Query) -> DataFrame:
    """(dataset, cell_type, block, bits) of the cells that satisfy the query, some blocks of which may be empty. Each block of a
    type is decided on its own: its genes' bitmaps are intersected or united by role, and what is excluded is taken off."""
    roles = {"p": q.required, "o": q.any_of, "x": q.excluded, "xo": q.excluded_any}

    def of(role: str):
        return F.col("gene").isin(roles[role])

    aggregates = []
    for role, genes in roles.items():
        if genes:
            unite = F.bitmap_or_agg if role in ("o", "xo") else F.bitmap_and_agg
            aggregates += [unite(F.when(of(role), F.expr(WHOLE))).alias(role), F.count_if(of(role)).alias(f"n_{role}")]
    found = bitmaps.where(F.col("gene").isin(q.genes)).groupBy(*KEY).agg(*aggregates)
    if q.required:
        found = found.where(F.col("n_p") == len(q.required))
    if q.any_of:
        found = found.where("n_o > 0")
    if q.only_excludes:
        found = _all_cells(types).join(found, KEY, "left").fillna(0, [f"n_{r}" for r in ("x", "xo") if roles[r]])
    else:
        found = found.withColumn("cells", F.lit(BITS))

    def run(batches):
        for b in _slices(batches):
            cells = b.column("cells").to_numpy()
            bits = np.packbits(np.arange(BITS) < cells[:, None], axis=1, bitorder="little") if q.only_excludes else np.full((b.num_rows, BYTES), 255, np.uint8)
            for role in ("p", "o"):
                if roles[role]:
                    bits = bits & _matrix(b.column(role))
            if q.excluded or q.excluded_any:
                gone = np.full_like(bits, 255)
                if q.excluded:
                    all_there = b.column("n_x").to_numpy() == len(q.excluded)
                    gone &= np.where(all_there[:, None], _matrix(b.column("x")), 0).astype(np.uint8)
                if q.excluded_any:
                    some = b.column("n_xo").to_numpy() > 0
                    gone &= np.where(some[:, None], _matrix(b.column("xo")), 0).astype(np.uint8)
                bits = bits & ~gone
            keep = bits.any(axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(c).filter(pa.array(keep)) for c in KEY], _binary(bits[keep])], names=[*KEY, "bits"])

    return found.mapInArrow(run, _BLOCKS)


def unpack(blocks: DataFrame) -> DataFrame:
    """(dataset, cell_type, cell_id) of the cells in blocks."""

    def run(batches):
        for b in _slices(batches):
            row, at = np.nonzero(np.unpackbits(_matrix(b.column("bits")), axis=1, bitorder="little"))
            ids = (b.column("block").to_numpy()[row] - 1) * BITS + at + 1
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("dataset").take(row), b.column("cell_type").take(row), pa.array(ids, pa.int64())], names=["dataset", "cell_type", "cell_id"])

    return blocks.mapInArrow(run, "dataset string, cell_type string, cell_id long")


def overlaps(bitmaps: DataFrame, blocks: DataFrame) -> DataFrame:
    """(gene, overlap): how many of the blocks' cells have each gene."""
    both = bitmaps.select("gene", *KEY, "bits").join(blocks.withColumnRenamed("bits", "hits"), KEY).select("gene", "bits", "hits")

    def run(batches):
        for b in _slices(batches):
            n = np.bitwise_count(_matrix(b.column("bits")) & _matrix(b.column("hits"))).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("gene"), pa.array(n)], names=["gene", "n"])

    return both.mapInArrow(run, "gene string, n long").groupBy("gene").agg(F.sum("n").alias("overlap"))


def bitmaps_of(atlas: Atlas) -> DataFrame:
    """The index's bitmaps, made from its entries where it has none."""
    return atlas.bitmaps if atlas.bitmaps is not None else of_entries(atlas.expression)
