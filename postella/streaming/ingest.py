"""Growing a saved index from a stream of new datasets, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.tables import append, from_long


def grow(stream: DataFrame, path: str, checkpoint: str, qb: int = 2):
    """A stream of (dataset, label, cell, gene, value) where each micro-batch brings whole types. A batch is appended to the index
    under its number, so a retry changes nothing; readers see whole batches."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            append(from_long(batch, qb), path, f"batch-{number:010d}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
