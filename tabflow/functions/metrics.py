"""Evaluation metrics as aggregate columns over one row per prediction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _whole(c: Column) -> Column:
    return c.cast("int")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom)


def _true_positives(pred: Column, true: Column) -> Column:
    return F.count_if((_whole(pred) == 1) & (_whole(true) == 1))


def accuracy(pred: Column, true: Column) -> Column:
    return F.avg((_whole(pred) == _whole(true)).cast("double"))


def precision(pred: Column, true: Column) -> Column:
    """0 where nothing was predicted positive."""
    return F.coalesce(_ratio(_true_positives(pred, true), F.count_if(_whole(pred) == 1)), F.lit(0.0))


def recall(pred: Column, true: Column) -> Column:
    """NaN where no row is positive."""
    return F.coalesce(_ratio(_true_positives(pred, true), F.count_if(_whole(true) == 1)), F.lit(float("nan")))


def f1(pred: Column, true: Column) -> Column:
    p, r = precision(pred, true), recall(pred, true)
    total = p + r
    return F.when((total > 0) & ~F.isnan(total), 2 * p * r / total).otherwise(F.lit(0.0))


def mean_absolute_error(pred: Column, true: Column) -> Column:
    return F.avg(F.abs(pred.cast("double") - true.cast("double")))


def mean_squared_error(pred: Column, true: Column) -> Column:
    diff = pred.cast("double") - true.cast("double")
    return F.avg(diff * diff)


def root_mean_squared_error(pred: Column, true: Column) -> Column:
    return F.sqrt(mean_squared_error(pred, true))


def r2(pred: Column, true: Column) -> Column:
    """For a constant target: 1 when every residual is zero, else NaN."""
    y = true.cast("double")
    residual = mean_squared_error(pred, true)
    spread = F.var_pop(y)
    constant = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(float("nan")))
    return F.when(F.max(y) == F.min(y), constant).otherwise(1 - residual / F.nullif(spread, F.lit(0.0)))


# Metric names and their short forms, by task.
REGRESSION: dict[str, Metric] = {
    "mean_absolute_error": mean_absolute_error,
    "mean_squared_error": mean_squared_error,
    "root_mean_squared_error": root_mean_squared_error,
    "r2_score": r2,
}
CLASSIFICATION: dict[str, Metric] = {
    "accuracy_score": accuracy,
    "precision_score": precision,
    "recall_score": recall,
    "f1_score": f1,
}
ALIASES = {
    "mae": "mean_absolute_error",
    "mse": "mean_squared_error",
    "rmse": "root_mean_squared_error",
    "r2": "r2_score",
    "accuracy": "accuracy_score",
    "precision": "precision_score",
    "recall": "recall_score",
    "f1": "f1_score",
}


def metric(name: str) -> Metric:
    full = ALIASES.get(name, name)
    found = {**REGRESSION, **CLASSIFICATION}.get(full)
    if found is None:
        raise ValueError(f"unknown metric {name!r}; known: {sorted([*REGRESSION, *CLASSIFICATION, *ALIASES])}")
    return found
