"""Helpers of the operators: row keys, sizes, measured broadcasts, number of shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes, as measured on the written table; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def documents_of(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only what an operator reads, under fixed names, so that other columns cannot clash."""
    return df.select(df[id_column].cast("long").alias("doc_id"), df[text_column].cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of what the plan reads, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards(df: DataFrame, bytes_each: int) -> int:
    """Number of parts of about so many bytes: by the files of a plain scan; else the texts are measured."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    size = plan_bytes(df)
    if leaves != 1 or size >= 1 << 50:
        size = df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, math.ceil(size / bytes_each))


def measured(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files, unpacked to four times their size at most, are small."""
    return F.broadcast(df) if 4 * plan_bytes(df) <= BROADCAST_BYTES else df
