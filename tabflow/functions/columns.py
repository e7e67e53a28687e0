"""Null-safe column expressions. All are built-in Spark functions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def empty_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Empty strings become NULL in every string column (or in the named ones)."""
    names = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    if columns is not None:
        names &= set(columns)
    if not names:
        return df
    return df.select([F.nullif(F.col(quote(c)), F.lit("")).alias(c) if c in names else F.col(quote(c)) for c in df.columns])


def quote(name: str) -> str:
    """A column name safe to give to F.col when it may hold dots, spaces or backticks."""
    return "`" + name.replace("`", "``") + "`"


def safe_cast(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that gives NULL instead of an error. Text is true only when it is exactly ``true``."""
    if source == target:
        return c
    if isinstance(target, T.ArrayType) or isinstance(source, T.ArrayType):
        return c
    if isinstance(target, T.BooleanType):
        if isinstance(source, T.StringType):
            return c == F.lit("true")
        if isinstance(source, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return c != F.lit(0)
        if isinstance(source, T.NullType):
            return c.cast(target)
        raise TypeError(f"cannot read {source.simpleString()} as boolean")
    if isinstance(source, T.BooleanType) and isinstance(target, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast(target)
    return c.try_cast(target)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low or 0, high or no limit]. NULL and NaN pass unchanged."""
    bounded = F.greatest(c, F.lit(0 if low is None else low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(c.isNull() | F.isnan(c), c).otherwise(bounded)


def virtual_name(column: str, value: Any) -> str:
    """Name of the one-hot column for one value; the single place where such names are made."""
    if isinstance(value, bool):
        value = str(value).lower()
    return f"{column}_{value}".replace("-", "_")


def embedding_name(column: str) -> str:
    return f"{column}_embedding"


def row_digest(columns: Sequence[str], *extra: Column) -> Column:
    """64-bit hash of several columns, NULLs kept apart from absent values by their position."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(quote(c)), F.col(quote(c)).isNull()]
    return F.xxhash64(*parts, *extra)
