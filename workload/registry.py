"""Registry of queries and of the SQL that must give the same rows; shared inputs."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(n: int, column: str, key: str):
    """The column with a NULL wherever the key is a multiple of n (the tables hold no NULLs)."""
    return F.when(F.col(key) % n != 0, F.col(column))


def half_up(value: float, places: int) -> float:
    """Rounded as SQL rounds: halves of the written number go up."""
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


# Events with NULLs by rule and a rule-based split; the same rules in SQL.
EVENTS_SQL = """
WITH ev AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 7 <> 0 THEN value END AS value,
         CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split
  FROM events)
"""


def holed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.col("event_id") % 10
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        every(11, "event_type", "event_id").alias("event_type"),
        every(7, "value", "event_id").alias("value"),
        F.when(bucket < 6, "train").when(bucket < 8, "valid").otherwise("test").alias("split"),
    )
