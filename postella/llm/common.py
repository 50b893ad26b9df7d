"""Helpers that the operators share: column picking, Arrow text buffers, sizing, shipping."""

from __future__ import annotations

import ctypes
import math
import os
import pickle
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A null id sorts before every other id.
NULL_ID = np.iinfo(np.int64).min
#: Rows of a few numbers that one task reads.
READ = 1 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_postella_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="postella"), "postella_ship.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._postella_shipped = True


def flat(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with columns renamed by position, so clashing names can't be ambiguous."""
    names = df.columns
    return df.toDF(*[f"__c{i}" for i in range(len(names))]), names


def position(names: list[str], name: str) -> int:
    """Index of the column: the first of exactly that name, else the first that differs only in case."""
    if name in names:
        return names.index(name)
    lower = [n.lower() for n in names]
    if name.lower() in lower:
        return lower.index(name.lower())
    raise ValueError(f"no column {name!r} among {names}")


def pick(df: DataFrame, **want: tuple[str, str]) -> DataFrame:
    """Only the wanted columns: output name = (source column, type)."""
    plain, names = flat(df)
    return plain.select(*[F.col(f"__c{position(names, src)}").cast(kind).alias(dst) for dst, (src, kind) in want.items()])


def pick_with_rest(df: DataFrame, **want: tuple[str, str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns as by `pick`, then all columns of the frame, named by position; and their names."""
    plain, names = flat(df)
    first = [F.col(f"__c{position(names, src)}").cast(kind).alias(dst) for dst, (src, kind) in want.items()]
    return plain.select(*first, *[F.col(c) for c in plain.columns]), names


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that the frame reads, as Catalyst knows them; a frame over something of
    unknown size is measured by the length of its strings."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if total < 1 << 60:
        return total
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(8))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def partitions(df: DataFrame, target_bytes: int = 16 << 20) -> int:
    """Shuffle partitions: the session's number, or more where the input asks for more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(plan_bytes(df) / target_bytes))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def gathered(df: DataFrame) -> DataFrame:
    """A frame of few numbers a row, at a checkpoint and read from there in as many tasks as its rows ask for: what is
    small doesn't take a task for each shuffle partition again wherever it is read."""
    df = checkpoint(df)
    return df.coalesce(max(1, math.ceil(df.count() / READ)))


def pack(obj) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(obj, protocol=5))


def unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def released(run):
    """A task's function that gives freed memory back to the system when it ends, as its worker serves the next stage too."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def to_part(n: int, df: DataFrame, column: str) -> DataFrame:
    """Deal rows to the partition whose number stands in the column."""
    return df.repartitionById(n, F.col(column))


def ids_of(array: pa.Array) -> np.ndarray:
    return array.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    _, offs, data = array.buffers()
    n = len(array)
    o = np.frombuffer(offs, np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
    return o, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


class Chunk:
    """Some whole documents: ids, whether the text was null, byte offsets from 0, bytes, other columns."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, ids: np.ndarray, offs: np.ndarray, data: np.ndarray):
        self.batch, self.lo, self.hi = batch, lo, hi
        self.ids = ids[lo:hi]
        self.offs = offs[lo : hi + 1] - offs[lo]
        self.data = data[offs[lo] : offs[hi]]
        self.null = batch.column(1).slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return self.hi - self.lo

    def texts(self) -> list[bytes]:
        raw, o = self.data.tobytes(), self.offs.tolist()
        return [raw[o[i] : o[i + 1]] for i in range(len(self))]

    def column(self, i: int) -> pa.Array:
        return self.batch.column(i).slice(self.lo, len(self))


def chunks(batches: Iterable[pa.RecordBatch], max_bytes: int) -> Iterator[Chunk]:
    """Batches (id, text, ...) in pieces of whole documents, of at most max_bytes unless one text is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = ids_of(batch.column(0))
        offs, data = text_buffers(batch.column(1))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield Chunk(batch, lo, hi, ids, offs, data)
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 (murmur's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def in_part(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def group_slices(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, then the distinct keys' starts in it (with the end appended)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return order, s[starts] if len(s) else s, np.r_[starts, len(s)]


