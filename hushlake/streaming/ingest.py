"""Sealing a stream as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def seal_stream(rows: DataFrame, store: Store, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Add each micro-batch to the store; a batch that is delivered again after a failure is added once."""

    def add(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            store.insert(batch, batch=f"{checkpoint}#{number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
