"""A stored family of suffix indexes: batches of documents are deduplicated against all that came before.

The family lies in a folder. A batch's sampled suffixes (``suffix_dedup.py``) get their suffix arrays, are merge-scanned
against the levels that exist, and become a level; levels of equal size merge, so that batches of equal size make
at most log2 of their number of levels. A level keeps the runs around anchors that suffixes start in, each content once, without
names: whatever is in a level is earlier than whatever comes.

Which levels and batches there are is told by numbered snapshots that are renamed into place: a batch that fails
or is lost leaves the family as it was, and one that is added again under its name gives the result it had.
"""

from __future__ import annotations

import uuid

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Manifest
from .anchors import HASHES, PARTS_SQL, RUNS, anonymous, hot_anchors, merged_levels, repeated_ids, resolved, run_rows
from .common import NULL_ID, pick, to_part
from .suffix_dedup import SQL, _make, _spec, _windows


class SuffixFamily:
    """The family in a folder. `parts`, the number of partitions that anchors are dealt to, is for the whole family: choose it
    by what will be added, some 6 MB of text for each. It, `length` and `k` are fixed by the first batch, and so are the anchors
    that count as hot; others that become so meet in one partition as well, only slower."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, length: int = 50, k: int = 12):
        self.spark, self.path, self.parts, self.spec = spark, path, parts, _spec(length, k)
        self.manifest = Manifest(spark, path)

    def _start(self, hot) -> dict:
        return {"parts": self.parts, "length": self.spec.length, "k": self.spec.k, "hot": [int(x) for x in hot], "levels": [], "batches": []}

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(PARTS_SQL).parquet(f"{self.path}/{name}")

    def levels(self) -> list[int]:
        """Bytes of the levels, the oldest first."""
        return [x["bytes"] for x in self.manifest.read()[1].get("levels", [])]

    def add(self, docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The batch's documents as by `suffix_dedup`, where all batches before count as documents of smaller id. Null ids and texts,
        ties, repeated rows, empty tables and clashing names are as there. One writer at a time adds to a family."""
        version, snapshot = self.manifest.read()
        if name in snapshot.get("batches", []):
            return self._result(name)
        # no document's id is that of the levels' content, which is before all
        rows = pick(docs, k=(id_col, "long"), t=(text_col, "string")).withColumn("k", F.coalesce("k", F.lit(NULL_ID + 1)))
        if not version:
            snapshot = self._start(hot_anchors(rows, self.spec))
        if (snapshot["parts"], snapshot["length"], snapshot["k"]) != (self.parts, self.spec.length, self.spec.k):
            raise ValueError(f"the family at {self.path} has {snapshot['parts']} parts, length {snapshot['length']} and k {snapshot['k']}")
        repeated = repeated_ids(rows)
        at = f"batches/{name}"
        run_rows(rows, self.spec, self.parts, np.array(snapshot["hot"], np.uint64), repeated).write.mode("overwrite").parquet(f"{self.path}/{at}/runs")
        mine = every = self._table(f"{at}/runs")
        for level in snapshot["levels"]:
            every = every.union(self._table(f"levels/{level['name']}"))
        out = resolved(every, rows, self.spec, _windows(self.spec), SQL, _make(self.spec.length), self.parts, repeated)
        out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID + 1, F.col("doc_id"))).write.mode("overwrite").parquet(f"{self.path}/{at}/result")
        fresh = self._written(mine.where(F.col("kind").isin(RUNS, HASHES)).mapInArrow(anonymous(self.spec), PARTS_SQL))
        levels = [*snapshot["levels"], fresh]
        while len(levels) > 1 and levels[-2]["bytes"].bit_length() <= levels[-1]["bytes"].bit_length():
            two = self._table(f"levels/{levels[-2]['name']}").union(self._table(f"levels/{levels[-1]['name']}"))
            levels[-2:] = [self._written(to_part(self.parts, two, "part").mapInArrow(merged_levels(self.spec), PARTS_SQL))]
        if not self.manifest.commit(version + 1, {**snapshot, "levels": levels, "batches": [*snapshot["batches"], name]}):
            raise RuntimeError(f"another batch was added to {self.path} meanwhile")
        return self._result(name)

    def _written(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/levels/{name}")
        size = self._table(f"levels/{name}").agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0]
        return {"name": name, "bytes": int(size)}

    def _result(self, name: str) -> DataFrame:
        return self.spark.read.schema(SQL).parquet(f"{self.path}/batches/{name}/result")
