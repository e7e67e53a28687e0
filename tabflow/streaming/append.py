"""Append-only stores fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabflow.sources.store import Store


def stream_append(rows: DataFrame, store: Store, checkpoint: str, order_by: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Each batch adds only keys that are not stored. A repeated batch adds nothing, so the sink is exactly-once by key."""
    if not rows.isStreaming:
        raise ValueError("rows must be a stream")

    def write(batch: DataFrame, _: int) -> None:
        store.append_new(batch, order_by)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def dedupe_stream(rows: DataFrame, key: str, event_time: str, keep: str) -> DataFrame:
    """First row per key among rows whose event times lie within ``keep``; older keys leave the state."""
    return rows.withWatermark(event_time, keep).dropDuplicatesWithinWatermark([key])
