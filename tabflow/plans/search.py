"""Random search over hyperparameters; every trial is a distributed fit."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.plans.model import DEFAULTS, Model
from tabflow.session import materialize

# Default search ranges.
RANGES: dict[str, dict[str, dict[str, Any]]] = {
    "gbtree": {
        "learning_rate": {"min": 0.001, "max": 0.3, "log": True},
        "max_depth": {"min": 3, "max": 10},
        "n_estimators": {"min": 100, "max": 1000},
        "min_child_weight": {"min": 0.0, "max": 10.0},
        "scale_pos_weight": {"min": 0, "max": 200},
        "gamma": {"min": 0.0, "max": 10.0},
        "subsample": {"min": 0.1, "max": 1.0},
        "colsample_bytree": {"min": 0.1, "max": 1.0},
    },
    "gblinear": {
        "n_estimators": {"min": 100, "max": 1000},
        "lambda": {"min": 0.0, "max": 10.0},
        "alpha": {"min": 0.0, "max": 1.0},
    },
}


def draw(rng: np.random.Generator, spec: Any) -> Any:
    """A value from options, a log-uniform, a whole-number or a uniform range; anything else is a fixed value."""
    if not isinstance(spec, Mapping):
        return spec
    if "options" in spec:
        return spec["options"][int(rng.integers(len(spec["options"])))]
    low, high = spec["min"], spec["max"]
    if spec.get("log"):
        return float(np.exp(rng.uniform(np.log(low), np.log(high))))
    if isinstance(low, int) and isinstance(high, int):
        return int(rng.integers(low, high + 1))
    return float(rng.uniform(low, high))


@dataclass
class SearchResult:
    trials: DataFrame
    best: Model
    best_value: float


def search(
    processed: DataFrame,
    model: Model,
    metric: str,
    direction: str,
    n_trials: int = 100,
    ranges: Mapping[str, Any] | None = None,
    parallelism: int = 2,
    seed: int = 42,
    custom=None,
) -> SearchResult:
    """Trial 0 uses the model's own parameters, the others draw from ``ranges`` merged over the defaults.

    Each trial trains on train rows and is measured on valid rows. The processed rows are written once, so that a trial
    does not repeat the normalisation.
    """
    if direction not in ("minimize", "maximize"):
        raise ValueError(f"unknown direction {direction!r}")
    spark = processed.sparkSession
    rows = materialize(processed, "search")
    space = {**RANGES[model.booster], **(ranges or {})}
    rng = np.random.default_rng(seed)
    plans = [dict(model.hyperparameters)]
    for _ in range(n_trials - 1):
        drawn = {k: draw(rng, v) for k, v in space.items() if k in DEFAULTS[model.booster]}
        plans.append({**model.hyperparameters, **drawn})

    def run(number: int) -> tuple[int, float, Model]:
        trial = Model(
            model.task, model.target, model.objective, model.booster, plans[number], model.weight, model.features, model.early_stopping, model.seed, patience=model.patience
        ).fit(rows)
        return number, float(trial.evaluate(rows, "valid", [metric] if custom is None else None, custom)[metric]), trial

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        done = list(pool.map(run, range(n_trials)))
    sign = 1 if direction == "minimize" else -1
    finite = [d for d in done if d[1] == d[1]]
    if not finite:
        raise ValueError(f"no trial has a value for {metric}")
    number, value, best = min(finite, key=lambda d: (sign * d[1], d[0]))
    table = spark.createDataFrame(
        [(n, {k: str(v) for k, v in plans[n].items()}, v) for n, v, _ in done], "trial int, hyperparameters map<string,string>, value double"
    )
    return SearchResult(table.withColumn("best", F.col("trial") == number), best, value)
