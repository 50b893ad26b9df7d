"""The folder that all machines of a cluster share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset a session on one machine, as in tests, gets a folder there; on a
    cluster that is an error, as no other machine would see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that all machines share is needed")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, and lost executors don't lose it."""
    path = f"{shared_folder(df.sparkSession)}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files for each task; the rows of a file take some ten times as much in memory.
TASK_BYTES = 8 << 20


def _leaf_bytes(plan) -> int:
    """Bytes that the leaves of a plan have. What is kept but not made yet has only an estimate, the product of what it joins, so
    what it reads counts instead; what has no known size says nothing."""
    leaves, total = plan.collectLeaves(), 0
    for leaf in map(leaves.apply, range(leaves.size())):
        if leaf.nodeName() == "InMemoryRelation" and not leaf.cacheBuilder().isCachedColumnBuffersLoaded():
            total += _leaf_bytes(leaf.cacheBuilder().logicalPlan())
        elif (n := int(str(leaf.stats().sizeInBytes()))) < 1 << 60:
            total += n
    return total


def tasks_for(*frames: DataFrame) -> int:
    """Tasks among which the rows of the frames are dealt, by the size of the files and tables that they read, so that no task
    grows with the input."""
    total = max((_leaf_bytes(df._jdf.queryExecution().optimizedPlan()) for df in frames), default=0)
    return max(1, math.ceil(total / TASK_BYTES))
