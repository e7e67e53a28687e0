"""Scoring of arriving rows with a fitted dataset and model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabflow.plans.dataset import Dataset
from tabflow.plans.model import Model, score
from tabflow.streaming.batches import stream_batches


def stream_score(
    rows: DataFrame, dataset: Dataset, model: Model, path: str, checkpoint: str, available_now: bool = True, reread: bool = False
) -> StreamingQuery:
    """The batch scoring plan over a stream. It uses fitted values only, so it keeps no state and appends.

    One plan sees stored features as they are when it starts; with ``reread`` every micro-batch lists the stores again."""
    if not rows.isStreaming:
        raise ValueError("rows must be a stream")
    if reread:
        return stream_batches(rows, lambda batch, _: score(batch, dataset, model), path, checkpoint, available_now)
    writer = score(rows, dataset, model).writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def stream_normalize(rows: DataFrame, dataset: Dataset, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = dataset.normalize(rows, inference=True).writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
