"""Source to processed table in one job: read, split, learn, fit features, normalise, learn the processed statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabflow.plans.dataset import Dataset
from tabflow.sources.files import Source
from tabflow.sources.schema import improve
from tabflow.sources.store import read_snapshot, version_name, write_snapshot


@dataclass
class Refreshed:
    version: str
    raw: DataFrame
    processed: DataFrame


def refresh(spark: SparkSession, source: Source, dataset: Dataset, root: str, version: str | None = None, improve_types: bool = False) -> Refreshed:
    """Writes a raw and a processed snapshot below ``root`` and saves the fitted state next to them.

    The source is read to place the split and to write the raw snapshot; all else reads that table, partitioned by split, so
    passes over training rows open the training folder only. A model keeps working on the version it was trained with.
    """
    version = version or version_name()
    rows = source.read(spark)
    if improve_types:
        rows = improve(rows)
    write_snapshot(dataset.split(rows), f"{root}/raw", version, ["split"])
    raw = read_snapshot(spark, f"{root}/raw", version)
    dataset.root = f"{root}/fitted/version={version}"
    dataset.fit(raw)
    write_snapshot(dataset.normalize(raw), f"{root}/processed", version, ["split"])
    processed = read_snapshot(spark, f"{root}/processed", version)
    dataset.learn_processed(processed)
    dataset.save(spark, f"{root}/state/version={version}")
    return Refreshed(version, raw, processed)
