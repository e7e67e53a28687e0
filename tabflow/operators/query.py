"""The query verbs, in one fixed order: filter, select, distinct, sort, drop, cast, empty string to NULL, limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import empty_to_null, quote, safe_cast
from tabflow.functions.types import spark_type


def query(
    df: DataFrame,
    filter: Column | str | None = None,
    select: Sequence[str] | None = None,
    unique: bool = False,
    sort: str | Sequence[str] | None = None,
    descending: bool = False,
    drop_cols: Sequence[str] = (),
    cast: Mapping[str, str | T.DataType] | None = None,
    limit: int | None = None,
    nulls_for_empty: bool = True,
) -> DataFrame:
    """One query over a frame. The filter may use columns that are not selected and still sees empty strings."""
    if filter is not None:
        df = df.filter(filter)
    if select is not None:
        df = df.select([F.col(quote(c)) for c in ([select] if isinstance(select, str) else select)])
    if unique:
        df = df.distinct()
    if sort is not None:
        df = df.orderBy(*sort_order([sort] if isinstance(sort, str) else sort, descending))
    if drop_cols:
        df = df.drop(*[c for c in drop_cols if c in df.columns])
    if cast:
        df = cast_columns(df, cast)
    if nulls_for_empty:
        df = empty_to_null(df)
    if limit is not None:
        df = df.limit(limit)
    return df


def sort_order(columns: Sequence[str], descending: bool = False) -> list[Column]:
    """NULLs come first in both directions."""
    return [F.col(quote(c)).desc_nulls_first() if descending else F.col(quote(c)).asc_nulls_first() for c in columns]


def cast_columns(df: DataFrame, cast: Mapping[str, str | T.DataType]) -> DataFrame:
    """Non-strict cast of the columns that are present: a value that does not fit becomes NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        target = cast.get(f.name)
        if target is not None:
            target = spark_type(target) if isinstance(target, str) else target
            c = safe_cast(c, f.dataType, target)
        out.append(c.alias(f.name))
    return df.select(out)


def features_and_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Two projections of one frame: everything but the target, and the target."""
    return df.drop(target), df.select(F.col(quote(target)))


def segment(df: DataFrame, name: str = "all", hidden: Sequence[str] = (), all_columns: bool = False) -> DataFrame:
    """Rows of one split (``all`` for every row) without hidden columns. On a partitioned table this prunes folders."""
    if name not in ("all", "train", "valid", "test"):
        raise ValueError(f"unknown segment {name!r}")
    if name != "all":
        df = df.filter(F.col("split") == name)
    return df if all_columns else df.drop(*hidden)


def column_view(df: DataFrame, column: str, virtual: Sequence[str] = ()) -> DataFrame:
    """A column together with those of its virtual columns that the frame holds."""
    wanted = [c for c in (column, *virtual) if c in df.columns]
    if not wanted:
        raise ValueError(f"column {column!r} is not in the frame")
    return df.select([F.col(quote(c)) for c in wanted])


def sample_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5) -> dict[str, list]:
    """A few non-null values per column; every read stops as soon as it has them."""
    return {
        c: [r[0] for r in df.select(F.col(quote(c))).filter(F.col(quote(c)).isNotNull()).limit(n).collect()]
        for c in (columns or df.columns)
    }


def num_rows(df: DataFrame) -> int:
    return df.count()


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
