"""Evaluation of predictions in one aggregation, AUC, and the release gate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import quote
from tabflow.functions.metrics import ALIASES, CLASSIFICATION, REGRESSION, metric
from tabflow.operators.ordering import running_total
from tabflow.session import cut_lineage


class Evaluator:
    """A custom metric: aggregate columns over the frame of predictions. It may give several, by name."""

    direction = "maximize"
    description = ""

    def supports_task(self, task: str) -> bool:
        return True

    def aggregates(self, pred: Column, true: Column) -> Mapping[str, Column] | Column:
        raise NotImplementedError


def default_metrics(task: str) -> list[str]:
    if task == "regression":
        return list(REGRESSION)
    if task == "classification":
        return list(CLASSIFICATION)
    raise ValueError(f"unknown task {task!r}")


def _number(df: DataFrame, name: str) -> Column:
    c = F.col(quote(name))
    return c.cast("int") if isinstance(df.schema[name].dataType, T.BooleanType) else c


def evaluation_frame(
    df: DataFrame,
    pred: str,
    true: str,
    metrics: Sequence[str],
    custom: Mapping[str, Evaluator | Callable[[Column, Column], Column]] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row (or one per group of ``by``) with every metric; truth and prediction share a row, so sizes cannot differ."""
    p, t = _number(df, pred), _number(df, true)
    out = [metric(m)(p, t).alias(ALIASES.get(m, m)) for m in metrics]
    for name, e in (custom or {}).items():
        found = e.aggregates(p, t) if isinstance(e, Evaluator) else e(p, t)
        out += [c.alias(n) for n, c in found.items()] if isinstance(found, Mapping) else [found.alias(name)]
    return df.groupBy(*[F.col(quote(c)) for c in by]).agg(*out) if by else df.agg(*out)


def evaluate(
    df: DataFrame,
    pred: str,
    true: str,
    task: str,
    metrics: Sequence[str] | None = None,
    custom: Mapping[str, Evaluator | Callable[[Column, Column], Column]] | None = None,
) -> dict[str, Any]:
    for e in (custom or {}).values():
        if isinstance(e, Evaluator) and not e.supports_task(task):
            raise ValueError(f"{type(e).__name__} does not support {task}")
    row = evaluation_frame(df, pred, true, metrics or default_metrics(task), custom).first()
    return row.asDict()


def passes(value: float, threshold: float, direction: str) -> bool:
    """Strictly below the threshold when minimising, strictly above when maximising. NaN never passes."""
    if direction == "minimize":
        return value < threshold
    if direction == "maximize":
        return value > threshold
    raise ValueError(f"unknown direction {direction!r}")


def auc_frame(df: DataFrame, score: str, true: str) -> DataFrame:
    """Area under the ROC curve, one row ``auc``, by ranks with ties counted half.

    Rows are first combined to one row per score with its positives and negatives, so a score that most rows share is
    one row; the negatives below each score come from a running total without a single-task sort.
    """
    positive = _number(df, true).cast("int") == 1
    per_score = cut_lineage(
        df.filter(F.col(quote(score)).isNotNull())
        .groupBy(F.col(quote(score)).cast("double").alias("score"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )
    ranked = running_total(per_score, "score", {"neg_below": F.col("neg")})
    # Sums as double: pairs of rows exceed a 64-bit integer on large tables.
    pairs = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2))
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.when(total > 0, pairs / total).alias("auc"))


def auc(df: DataFrame, score: str, true: str) -> float | None:
    return auc_frame(df, score, true).first().auc
