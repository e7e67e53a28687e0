"""Imputation with statistics of the training rows. Every step is an expression, so all columns are one projection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import clip, quote
from tabflow.operators.lookup import lookup
from tabflow.operators.stats import Categories, Statistics

OTHER = "other"


@dataclass(frozen=True)
class Step:
    """What to do with one column: a method, its parameters (``clip``, ``constant``, ``categorical_min``) and an encoding."""

    method: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)
    encoding: str | None = None

    @classmethod
    def of(cls, spec: Step | Mapping[str, Any] | None) -> Step | None:
        if spec is None or isinstance(spec, Step):
            return spec
        return cls(spec.get("method"), dict(spec.get("params") or {}), spec.get("encoding"))

    def param(self, name: str) -> Any:
        value = self.params.get(name)
        return None if value is False else value

    def clip_bounds(self) -> tuple[float | None, float | None] | None:
        bounds = self.param("clip")
        if bounds is None:
            return None
        return (bounds.get("min"), bounds.get("max")) if isinstance(bounds, Mapping) else tuple(bounds)

    @property
    def uses_categories(self) -> bool:
        return self.method == "categorical" or self.param("categorical_min") is not None or self.encoding in ("one_hot", "ordinal")

    @property
    def replaces_rare(self) -> bool:
        return self.method == "categorical" or self.param("categorical_min") is not None


def fill(c: Column, value: Any, t: T.DataType) -> Column:
    """NULLs become the value, cast to the column's type. A missing value leaves the column as it is; NaN is not NULL."""
    if value is None:
        return c
    return F.coalesce(c, F.lit(value).try_cast(t))


def today(run_date: dt.date | dt.datetime | None) -> dt.datetime:
    """Midnight (UTC) of the run date; pass the date so that a repeated run gives the same rows."""
    day = run_date or dt.datetime.now(dt.timezone.utc)
    return dt.datetime(day.year, day.month, day.day)


def impute_column(
    c: Column,
    name: str,
    t: T.DataType,
    step: Step,
    stats: Statistics,
    categories: Categories | None = None,
    run_date: dt.date | dt.datetime | None = None,
) -> Column:
    """The column after clip, mean, median, constant, last value, rare categories, most frequent and today, in this order."""
    bounds = step.clip_bounds()
    if bounds is not None:
        c = clip(c, *bounds).cast(t)
    if step.method == "mean":
        c = fill(c, stats.get(name, "mean"), t)
    if step.method == "median":
        c = fill(c, stats.get(name, "median"), t)
    if step.method == "constant" or step.param("constant") is not None:
        c = fill(c, step.params.get("constant"), t)
    if step.method == "ffill":
        c = fill(c, stats.get(name, "last_value"), t)
    if step.replaces_rare and categories is not None and categories.inline:
        c = rare_to_other(c, t, categories)
    if step.method == "most_frequent":
        c = fill(c, stats.get(name, "most_frequent_value"), t)
    if step.method == "today":
        c = F.coalesce(c, F.lit(today(run_date)).cast("timestamp_ntz").cast(t))
    return c


def rare_to_other(c: Column, t: T.DataType, categories: Categories) -> Column:
    """Values outside the allowed ones, NULL included, become ``other``; booleans and empty lists are left alone."""
    if isinstance(t, T.BooleanType) or not categories.values:
        return c
    return F.when(c.isin(*categories.values), c).otherwise(F.lit(OTHER))


def impute(
    df: DataFrame,
    steps: Mapping[str, Step | Mapping[str, Any]],
    stats: Statistics,
    categories: Mapping[str, Categories] | None = None,
    run_date: dt.date | dt.datetime | None = None,
) -> DataFrame:
    """Imputes all columns in one projection. Columns without a step, and steps without a column, pass through.

    A column with more allowed categories than fit a literal list is looked up in its table by a left join.
    """
    categories = categories or {}
    steps = {c: Step.of(s) for c, s in steps.items() if c in df.columns}
    tables = {c: categories[c] for c, s in steps.items() if s.replaces_rare and c in categories and not categories[c].inline}
    for c, cats in tables.items():
        df = _mark_known(df, c, cats)
    out = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if f.name in steps:
            step = steps[f.name]
            if f.name in tables and not isinstance(f.dataType, T.BooleanType):
                c = F.when(F.col(quote(f"_known_{f.name}")).isNotNull(), c).otherwise(F.lit(OTHER))
            c = impute_column(c, f.name, f.dataType, step, stats, categories.get(f.name), run_date)
        out.append(c.alias(f.name))
    return df.select(out).drop(*[f"_known_{c}" for c in tables])


def _mark_known(df: DataFrame, column: str, categories: Categories) -> DataFrame:
    known = categories.table.select(F.col("value").alias(f"_known_{column}"))
    return lookup(df, F.col(quote(column)).cast("string"), known, f"_known_{column}")
