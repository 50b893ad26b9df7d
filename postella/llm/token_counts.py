"""Token counts as delta-maintained rollups.

Documents are tokenised where they lie; their counts become signed changes: plus for an insert, minus for
a delete, minus the old and plus the new for a revision. A batch of changes is summed by source,
language and tokenizer version before anything moves, so a hot source is one row per task, and the
sums are committed to a ledger. Totals are the sum of what is committed: additive, in any order.

A commit is idempotent: its data are written aside, then a marker that names them is written aside and renamed to
the name of the batch, which fails if that exists; only data named by markers count. A crash before the rename leaves
nothing that counts, and the retry does it all. A retry of a batch, or two writers of one batch, count once.
`compact` folds what one listing of the markers shows into a snapshot: the totals, and a table of the batches folded
so far. Their markers go afterwards; a marker whose batch the snapshot has doesn't count. So neither the
listing nor what the driver holds grows with the batches ever committed, only with those since the last snapshot.

Rows: totals have one row for each source, language and tokenizer whose counts aren't all zero; null source
and language are groups of their own. A null or empty text counts as a document without tokens. Repeated rows, ties
among them, count as often as they stand; a very long text is tokenised whole. An empty table gives no rows, and an
empty batch is committed like any other. Columns are taken by name, the first of those that clash; others don't matter.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, pick

TOKENIZERS = "/opt/tokenizers"
_KEYS = ["source", "lang", "tokenizer"]
_SUMS = ["n_docs", "n_tokens", "n_bytes"]
_SQL = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
_BATCHES = "batch string"
_loaded: dict = {}


def tokenizer(path: str):
    """A byte-level BPE from a file of ranks, read once per worker."""
    if path not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_bytes) of every document row."""
    path = os.path.join(folder, f"{version}.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches):
        encode = tokenizer(path).encode_ordinary
        for chunk in chunks(batches, 8 << 20):
            texts = chunk.texts()
            yield pa.RecordBatch.from_arrays([chunk.column(0).cast(pa.int64()), chunk.column(2).cast(pa.string()), chunk.column(3).cast(pa.string()), pa.array([version] * len(chunk)), pa.array([len(encode(t.decode())) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pick(docs, k=(id_col, "long"), t=(text_col, "string"), source=(source_col, "string"), lang=(lang_col, "string"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_bytes long")


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Signed counts of counted documents (as `count_tokens` gives them); revised is a pair of old and new."""
    parts = [(inserted, 1), (deleted, -1), *zip(revised or (), (-1, 1), strict=False)]
    out = None
    for frame, sign in parts:
        if frame is not None:
            one = frame.select(*_KEYS, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"), (sign * F.col("n_bytes")).alias("n_bytes"))
            out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no change is given")
    return out


class Ledger:
    """Committed batches of changes in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        for folder in ("batches", "snapshots", "aside"):
            self._fs.mkdirs(self._path(f"{self.path}/{folder}"))
        # of the two interfaces of Hadoop only this one has a rename that fails where the name is taken
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _mark(self, name: str, note: dict) -> bool:
        """The marker, whole or not at all; false if it exists."""
        aside = self._path(f"{self.path}/aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(note).encode()))
        out.close()
        try:
            self._context.rename(aside, self._path(f"{self.path}/{name}"), self._no_overwrite)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(aside, False)
            return False
        return True

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")))

    def _note(self, name: str) -> dict | None:
        """What the marker says; None if it has gone."""
        try:
            reader = self._fs.open(self._path(f"{self.path}/{name}"))
        except Exception as e:
            if "FileNotFound" in str(e):
                return None
            raise
        said = json.loads(bytes(reader.readAllBytes()).decode())
        reader.close()
        return said

    def _snapshot(self) -> tuple[int, dict | None]:
        """Number and note of the last snapshot."""
        names = self._names("snapshots")
        return (int(names[-1]), self._note(f"snapshots/{names[-1]}")) if names else (0, None)

    def _folded(self, shot: dict | None, batches: list[str]) -> set[str]:
        """Those of the batches that the snapshot has."""
        if not shot or not batches:
            return set()
        asked = F.broadcast(self.spark.createDataFrame([(b,) for b in batches], _BATCHES))
        return {r.batch for r in self.spark.read.schema(_BATCHES).parquet(f"{self.path}/{shot['batches']}").join(asked, "batch", "left_semi").collect()}

    def _live(self) -> tuple[int, dict | None, dict[str, str]]:
        """The last snapshot, and the data of each batch that it doesn't have. Batches are listed first: a marker that
        has gone by then has gone into a snapshot that is listed after."""
        while True:
            names = self._names("batches")
            number, shot = self._snapshot()
            folded = self._folded(shot, names)
            notes = {b: self._note(f"batches/{b}") for b in names if b not in folded}
            if None not in notes.values():
                return number, shot, {b: note["data"] for b, note in notes.items()}

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add the batch's changes; false, and nothing is done, if a batch of that name is committed."""
        name = urllib.parse.quote(batch, safe="")
        # the marker goes after the snapshot has come, so it is looked for first
        if self._fs.exists(self._path(f"{self.path}/batches/{name}")) or self._folded(self._snapshot()[1], [name]):
            return False
        data = f"data/{uuid.uuid4().hex}"
        signed.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS]).write.parquet(f"{self.path}/{data}")
        # another writer's marker may have been folded and removed meanwhile: then this one doesn't count
        return self._mark(f"batches/{name}", {"data": data}) and not self._folded(self._snapshot()[1], [name])

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _SQL)
        found = self.spark.read.schema(_SQL).parquet(*[f"{self.path}/{d}" for d in folders])
        total = found.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS])
        return total.where(" or ".join(f"{c} <> 0" for c in _SUMS))

    def totals(self) -> DataFrame:
        """Additive totals of all committed batches."""
        _, shot, live = self._live()
        return self._sum(sorted(live.values()) + ([shot["data"]] if shot else []))

    def compact(self) -> bool:
        """Fold what one listing shows into a snapshot; false if another did so meanwhile. Old data stay, for those who
        are reading them."""
        number, shot, live = self._live()
        folder = f"data/{uuid.uuid4().hex}"
        note = {"data": f"{folder}/totals", "batches": f"{folder}/batches"}
        self._sum(sorted(live.values()) + ([shot["data"]] if shot else [])).coalesce(1).write.parquet(f"{self.path}/{note['data']}")
        batches = self.spark.createDataFrame([(b,) for b in sorted(live)], _BATCHES)
        if shot:
            batches = batches.union(self.spark.read.schema(_BATCHES).parquet(f"{self.path}/{shot['batches']}"))
        batches.write.parquet(f"{self.path}/{note['batches']}")
        if not self._mark(f"snapshots/{number + 1:012d}", note):
            return False
        for b in live:
            self._fs.delete(self._path(f"{self.path}/batches/{b}"), False)
        return True
