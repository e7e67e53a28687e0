"""Training, scoring and storing of models with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import quote
from tabflow.functions.types import is_numeric
from tabflow.operators.inspect import null_columns
from tabflow.plans.boosting import Boosted, _sigmoid, _softmax, boost, objective_of
from tabflow.plans.dataset import Dataset
from tabflow.plans.evaluate import evaluate, passes

# Objectives by kind of task.
OBJECTIVES = {
    "binary": ("binary:logistic", "binary:hinge"),
    "multiclass": ("multi:softmax", "multi:softprob"),
    "regression": ("reg:squarederror", "reg:logistic"),
}
BOOSTERS = ("gbtree", "gblinear")

# Default hyperparameters.
DEFAULTS = {
    "gbtree": {
        "learning_rate": 0.1,
        "max_depth": 6,
        "n_estimators": 100,
        "min_child_weight": 1,
        "subsample": 1.0,
        "colsample_bytree": 1.0,
        "gamma": 0.0,
        "scale_pos_weight": 1.0,
    },
    "gblinear": {
        "n_estimators": 100,
        "lambda": 1.0,
        "alpha": 0.0,
    },
}


class NotTrainable(ValueError):
    pass


class Model:
    def __init__(
        self,
        task: str,
        target: str,
        objective: str | None = None,
        booster: str = "gbtree",
        hyperparameters: Mapping[str, Any] | None = None,
        weight: str | None = None,
        features: Sequence[str] | None = None,
        early_stopping: bool = False,
        seed: int = 42,
        version: str | None = None,
        patience: int | None = None,
    ):
        """``patience`` ends boosting when the loss on the valid rows has not improved for so many rounds; it implies early stopping.

        Linear models are solved to their optimum, so they have no learning rate. Their ``lambda`` and ``alpha`` are penalties a row: the
        mean loss plus lambda / 2 times the squared weights plus alpha times their absolute values, inputs taken as they are.
        """
        if task not in ("classification", "regression"):
            raise ValueError("task must be classification or regression")
        if booster not in BOOSTERS:
            raise ValueError(f"booster must be one of {BOOSTERS}")
        if weight is not None and weight == target:
            raise ValueError("the weight column may not be the target")
        unknown = set(hyperparameters or {}) - set(DEFAULTS[booster])
        if unknown:
            raise ValueError(f"unknown hyperparameters for {booster}: {sorted(unknown)}")
        self.task, self.target, self.weight, self.booster = task, target, weight, booster
        self.objective = objective or ("reg:squarederror" if task == "regression" else "binary:logistic")
        self.hyperparameters = {**DEFAULTS[booster], **(hyperparameters or {})}
        self.features = list(features) if features is not None else None
        if patience is not None and booster != "gbtree":
            raise ValueError("only trees are boosted in rounds")
        self.early_stopping, self.seed, self.version, self.patience = early_stopping or patience is not None, seed, version, patience
        self.boosted: Boosted | None = None
        self.pipeline: PipelineModel | None = None
        self.classes: int | None = None
        self.widths: dict[str, int] = {}

    # ------------------------------------------------------------ training

    def check_objective(self, df: DataFrame) -> None:
        kind = "regression"
        if self.task == "classification":
            n = df.select(self.target).filter(F.col(quote(self.target)).isNotNull()).distinct().limit(3).count()
            kind = "binary" if n <= 2 else "multiclass"
        if self.objective not in OBJECTIVES[kind]:
            raise ValueError(f"{self.objective} does not fit a {kind} target; allowed: {OBJECTIVES[kind]}")

    def _inputs(self, df: DataFrame) -> list[str]:
        kept = {self.target, self.weight, "split"}
        return self.features or [
            f.name
            for f in df.schema.fields
            if f.name not in kept and (is_numeric(f.dataType) or isinstance(f.dataType, (T.BooleanType, T.ArrayType)))
        ]

    def matrix(self, df: DataFrame) -> DataFrame:
        """The frame with its inputs as numbers: booleans 0/1, vectors for embeddings, NaN for what is missing."""
        out = []
        for name in self.features:
            c = F.col(quote(name))
            if name in self.widths:
                empty = F.array_repeat(F.lit(float("nan")), self.widths[name])
                out.append(array_to_vector(F.coalesce(c.cast("array<double>"), empty)).alias(f"in_{name}"))
            else:
                out.append(F.coalesce(c.cast("double"), F.lit(float("nan"))).alias(f"in_{name}"))
        return df.select("*", *out)

    def fit(self, processed: DataFrame) -> Model:
        """Trains on the train rows; with early stopping, on train and valid rows with the valid rows held out."""
        df = processed
        self.features = self._inputs(df)
        if not self.features:
            raise NotTrainable("no numeric, boolean or vector column to train on")
        used = [*self.features, self.target, *([self.weight] if self.weight else [])]
        holes = null_columns(df, used)
        if holes:
            raise NotTrainable(f"training data holds NULLs in {holes}")
        self.check_objective(df)
        vectors = [c for c in self.features if isinstance(df.schema[c].dataType, T.ArrayType)]
        if vectors:
            sizes = df.agg(*[F.max(F.size(quote(c))).alias(f"w{i}") for i, c in enumerate(vectors)]).first()
            self.widths = {c: sizes[f"w{i}"] for i, c in enumerate(vectors)}
        if "split" in df.columns:
            df = df.filter(F.col("split").isin("train", "valid") if self._validates() else F.col("split") == "train")
        if self._boosts():
            return self._boost(self.training_frame(df))
        rows = self.training_frame(df)
        spread = _spread(rows) if self.booster == "gblinear" and self.objective == "reg:squarederror" else 1.0
        self.pipeline = self.estimator(spread).fit(rows)
        if self.task == "classification" and self.objective.startswith("multi"):
            self.classes = self._stage().numClasses
        return self

    def _boosts(self) -> bool:
        """Whether the boosting loop is used: Spark's own boosted trees know two losses and no patience."""
        return self.booster == "gbtree" and (self.patience is not None or self.objective not in ("binary:logistic", "reg:squarederror"))

    def _boost(self, rows: DataFrame) -> Model:
        self.pipeline = Pipeline(stages=self._assembly()).fit(rows)
        if self.objective.startswith("multi"):
            self.classes = int(rows.agg(F.max("label")).first()[0]) + 1
        held_out = "is_valid" if self._validates() else None
        objective = objective_of(self.objective, self.classes or 2)
        self.boosted = boost(self.pipeline.transform(rows), objective, self.hyperparameters, held_out=held_out, patience=self.patience, seed=self.seed)
        return self

    def _validates(self) -> bool:
        return self.early_stopping and self.booster == "gbtree"

    def training_frame(self, df: DataFrame) -> DataFrame:
        df = self.matrix(df).withColumn("label", F.col(quote(self.target)).cast("double"))
        weight = F.col(quote(self.weight)).cast("double") if self.weight else F.lit(1.0)
        balance = float(self.hyperparameters.get("scale_pos_weight", 1.0))
        if self.task == "classification" and balance != 1.0:
            weight = weight * F.when(F.col("label") == 1, balance).otherwise(1.0)
        df = df.withColumn("example_weight", weight)
        return df.withColumn("is_valid", F.col("split") == "valid") if self._validates() else df

    def estimator(self, spread: float = 1.0) -> Pipeline:
        """Training rows are checked for NULLs beforehand. Rows to be scored may lack inputs: they are kept, and NaN takes
        the upper branch of every tree, so one incomplete row does not fail the job."""
        return Pipeline(stages=[*self._assembly(), self._learner(spread)])

    def _assembly(self) -> list:
        hints = [VectorSizeHint(inputCol=f"in_{c}", size=n, handleInvalid="optimistic") for c, n in self.widths.items()]
        return [*hints, VectorAssembler(inputCols=[f"in_{c}" for c in self.features], outputCol="features", handleInvalid="keep")]

    def _learner(self, spread: float = 1.0):
        """``spread`` is the deviation of the labels, by which Spark divides the squared penalty of least squares."""
        h = self.hyperparameters
        common = {"featuresCol": "features", "labelCol": "label", "weightCol": "example_weight"}
        if self.booster == "gblinear":
            strength = float(h["lambda"]) * spread + float(h["alpha"])
            linear = {
                **common,
                "maxIter": int(h["n_estimators"]),
                "regParam": strength,
                "elasticNetParam": float(h["alpha"]) / strength if strength else 0.0,
                "standardization": False,
            }
            if self.objective == "reg:squarederror":
                return LinearRegression(**linear)
            if self.objective.startswith(("binary:logistic", "multi:")):
                return LogisticRegression(**linear)
            if h["alpha"]:
                raise ValueError(f"{self.objective} takes no alpha: its linear model has an L2 penalty only")
            if self.objective == "reg:logistic":
                return GeneralizedLinearRegression(**common, family="binomial", link="logit", maxIter=linear["maxIter"], regParam=strength)
            return LinearSVC(**common, maxIter=linear["maxIter"], regParam=strength, standardization=False)
        trees = {
            **common,
            "maxIter": int(h["n_estimators"]),
            "maxDepth": int(h["max_depth"]),
            "stepSize": float(h["learning_rate"]),
            "subsamplingRate": float(h["subsample"]),
            "minInstancesPerNode": max(1, round(float(h["min_child_weight"]))),
            "minInfoGain": float(h["gamma"]),
            "featureSubsetStrategy": "all" if float(h["colsample_bytree"]) >= 1 else str(float(h["colsample_bytree"])),
            "seed": self.seed,
        }
        if self._validates():
            trees["validationIndicatorCol"] = "is_valid"
        if self.task == "regression":
            return GBTRegressor(**trees)
        return GBTClassifier(**trees)

    def _stage(self):
        return self.pipeline.stages[-1]

    # ------------------------------------------------------------ scoring

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for classification with probabilities, ``probabilities`` rounded to 4 places."""
        if self.pipeline is None:
            raise NotTrainable("the model is not trained")
        scored = self.pipeline.transform(self.matrix(df))
        if self.boosted is not None:
            scored = self._from_margins(self.boosted.margins(scored))
        probabilities = self._probabilities(scored)
        prediction = F.col("prediction")
        if self.booster == "gblinear":
            # A sum has no value where a part is missing.
            missing = reduce(or_, [F.col(quote(c)).isNull() for c in self.features])
            prediction = F.when(~missing, prediction)
            probabilities = None if probabilities is None else F.when(~missing, probabilities).alias("probabilities")
        if self.task == "classification":
            prediction = prediction.cast("int")
        out = scored.select(*[F.col(quote(c)) for c in df.columns], prediction.alias("prediction"), *([probabilities] if probabilities is not None else []))
        return out

    def _from_margins(self, scored: DataFrame) -> DataFrame:
        m = F.col("margins")
        if self.objective.startswith("multi"):
            scored = scored.withColumn("probability", _softmax(m))
            return scored.withColumn("prediction", F.array_position("probability", F.array_max("probability")) - 1)
        one = _sigmoid(m[0])
        if self.task == "classification":
            return scored.withColumn("probability", F.array(1 - one, one)).withColumn("prediction", (m[0] > 0).cast("int"))
        return scored.withColumn("prediction", one if self.objective == "reg:logistic" else m[0])

    def _probabilities(self, scored: DataFrame) -> Column | None:
        if self.task != "classification" or self.objective == "binary:hinge":
            return None
        p = F.col("probability") if self.boosted is not None else vector_to_array("probability")
        return F.transform(p, lambda v: F.round(v, 4)).alias("probabilities")

    def evaluate(self, processed: DataFrame, segment: str = "test", metrics: Sequence[str] | None = None, custom=None) -> dict[str, Any]:
        rows = processed.filter(F.col("split") == segment) if "split" in processed.columns else processed
        return evaluate(self.predict(rows), "prediction", self.target, self.task, metrics, custom)

    def gate(self, metrics: Mapping[str, float], metric: str, threshold: float, direction: str) -> bool:
        return passes(metrics[metric], threshold, direction)

    def importances(self, spark: SparkSession) -> DataFrame:
        """feature, importance; 0 for an input the model does not use. A vector input has one row per element."""
        if self.boosted is not None:
            total = self.boosted.importances(len(self._slots()))
        else:
            total = [abs(float(v)) for v in _weights(self._stage())]
        return spark.createDataFrame(list(zip(self._slots(), total)), "feature string, importance double")

    def _slots(self) -> list[str]:
        out: list[str] = []
        for c in self.features:
            width = self.widths.get(c)
            out += [c] if width is None else [f"{c}_{i}" for i in range(width)]
        return out

    # ------------------------------------------------------------ storage

    def save(self, spark: SparkSession, root: str, version: str) -> str:
        path = f"{root}/version={version}"
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        if self.boosted is not None:
            self.boosted.save(spark, f"{path}/boosted")
        self.version = version
        config = {
            "patience": self.patience,
            "task": self.task,
            "target": self.target,
            "objective": self.objective,
            "booster": self.booster,
            "hyperparameters": self.hyperparameters,
            "weight": self.weight,
            "features": self.features,
            "seed": self.seed,
            "early_stopping": self.early_stopping,
            "version": version,
            "widths": self.widths,
            "classes": self.classes,
            "boosted": self.boosted is not None,
        }
        spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
        return path

    @classmethod
    def load(cls, spark: SparkSession, root: str, version: str) -> Model:
        path = f"{root}/version={version}"
        config = json.loads(spark.read.option("wholetext", True).text(f"{path}/config").first().value)
        widths, classes, boosted = config.pop("widths"), config.pop("classes"), config.pop("boosted")
        out = cls(**config)
        out.widths, out.classes = widths, classes
        if boosted:
            out.boosted = Boosted.load(spark, f"{path}/boosted")
        out.pipeline = PipelineModel.load(f"{path}/pipeline")
        return out


def _spread(rows: DataFrame) -> float:
    """The weighted deviation of the labels over all rows, by which Spark's normal equations scale them; 1 for constant labels."""
    w, y = F.col("example_weight"), F.col("label")
    mean = rows.agg(F.sum(w * y) / F.sum(w)).first()[0]
    if mean is None:
        return 1.0
    return (rows.agg(F.sum(w * (y - mean) * (y - mean)) / F.sum(w)).first()[0]) ** 0.5 or 1.0


def _weights(model) -> list[float]:
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray().tolist()
    if hasattr(model, "coefficientMatrix"):
        return abs(model.coefficientMatrix.toArray()).mean(axis=0).tolist()
    return model.coefficients.toArray().tolist()


def score(df: DataFrame, dataset: Dataset, model: Model) -> DataFrame:
    """Raw rows to predictions: raw input, normalised input, value, probabilities and model version, in one plan.

    The raw row travels along as a struct, so nothing is joined back.
    """
    raw = F.struct(*[F.col(quote(c)).alias(c) for c in df.columns]).alias("raw_input")
    carried = df.select("*", raw)
    ready = dataset.normalize(carried, inference=True, all_columns=True)
    visible = [c for c in dataset.mask(ready, inference=True).columns if c != "split"]
    scored = model.predict(ready)
    return scored.select(
        "raw_input",
        F.struct(*[F.col(quote(c)).alias(c) for c in visible]).alias("normalized_input"),
        F.col("prediction").alias("value"),
        *([F.col("probabilities")] if "probabilities" in scored.columns else []),
        F.lit(model.version).alias("model_version"),
    )
