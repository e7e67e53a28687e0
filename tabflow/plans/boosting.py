"""Gradient boosting of any objective: Newton steps over Spark ML regression trees.

A round computes each row's gradient g and curvature h of the loss at its margins, fits one regression tree per class to -g / h with
weight h, so that its best split is the one that lowers the loss most, and sets each leaf to -G / (H + penalty) over the leaf's rows.
Margins are arrays of one number per class. After every ``cut_every`` rounds the rows are written with them, all gradients and curvatures
and the loss, and read back: a round reads its rows some five times a class, so a written row is cheaper than the trees and the
objective that lead to it, and neither the plan nor the work to recompute a lost task grows with the rounds. The rows are first dealt
evenly, as a round is as slow as its largest task. What reaches the driver is two numbers a leaf and two losses a round.

With a column that marks held-out rows, rounds end when the loss on them has not improved for ``patience`` rounds, and the trees up to
the best round stay.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.session import materialize

#: The least curvature, the L2 penalty of leaves.
LEAST_CURVATURE = 1e-16
LEAF_PENALTY = 1.0
#: Rows of a task, about, where the cluster's cores are too few for all to have less.
ROWS_PER_TASK = 1_000_000
_BOUND = 1e-15


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(_BOUND)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; inside a lambda Spark would compute it for every element."""
    return F.transform(F.array(value), use)[0]


def _softmax(margins: Column) -> Column:
    powers = _once(F.struct(margins.alias("m"), F.array_max(margins).alias("top")), lambda s: F.transform(s["m"], lambda m: F.exp(m - s["top"])))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    return _once(powers, lambda p: _once(F.struct(p.alias("p"), total(p).alias("of")), lambda s: F.transform(s["p"], lambda e: e / s["of"])))


class Objective:
    """Per class k: the gradient and the curvature; per row: the loss. ``y`` is the label, ``m`` the array of margins."""

    classes = 1
    columns = ()

    def start(self, mean: float) -> float:
        """The margin of every row before the first round, from the mean of the labels."""
        return 0.0

    def step(self, y: Column, m: Column, k: int) -> tuple[Column, Column]:
        raise NotImplementedError

    def loss(self, y: Column, m: Column) -> Column:
        raise NotImplementedError

    def steps(self, y: Column, m: Column) -> Column:
        """An array of (g, h), one a class."""
        return F.array(*[F.struct(g.alias("g"), h.alias("h")) for g, h in (self.step(y, m, k) for k in range(self.classes))])


class SquaredError(Objective):
    def start(self, mean):
        return mean

    def step(self, y, m, k):
        return m[0] - y, F.lit(1.0)

    def loss(self, y, m):
        return (m[0] - y) * (m[0] - y)


class Logistic(Objective):
    """Labels from 0 to 1, whole or fractional."""

    def start(self, mean):
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return math.log(mean / (1 - mean))

    def step(self, y, m, k):
        p = _sigmoid(m[0])
        return p - y, F.greatest(p * (1 - p), F.lit(LEAST_CURVATURE))

    def loss(self, y, m):
        p = _sigmoid(m[0])
        return -(y * _log(p) + (1 - y) * _log(1 - p))


class Hinge(Objective):
    """Labels 0 and 1; the loss that is recorded is the hinge loss."""

    def step(self, y, m, k):
        side = 2 * y - 1
        inside = m[0] * side < 1
        return F.when(inside, -side).otherwise(0.0), F.when(inside, 1.0).otherwise(LEAST_CURVATURE)

    def loss(self, y, m):
        return F.greatest(F.lit(0.0), 1 - m[0] * (2 * y - 1))


class Softmax(Objective):
    """Labels 0 to classes - 1; the curvature is twice p (1 - p), as one step moves all classes."""

    def __init__(self, classes: int):
        self.classes = classes

    def _of(self, y, p, k):
        return p - (y == k).cast("double"), F.greatest(2 * p * (1 - p), F.lit(LEAST_CURVATURE))

    def step(self, y, m, k):
        return self._of(y, _softmax(m)[k], F.lit(k))

    def steps(self, y, m):
        def both(p, k):
            g, h = self._of(y, p, k)
            return F.struct(g.alias("g"), h.alias("h"))

        return F.transform(_softmax(m), both)

    def loss(self, y, m):
        return -_log(F.get(_softmax(m), y.cast("int")))


def objective_of(name: str, classes: int = 2) -> Objective:
    if name.startswith("multi:"):
        return Softmax(classes)
    return {"binary:logistic": Logistic, "reg:logistic": Logistic, "binary:hinge": Hinge, "reg:squarederror": SquaredError}[name]()


@dataclass
class Tree:
    model: DecisionTreeRegressionModel
    leaves: list[float]
    inputs: list[int] | None = None  #: places in the feature vector, None for all

    def value(self, df: DataFrame, name: str) -> DataFrame:
        """Adds the leaf value as a column."""
        sliced = f"_{name}_in"
        if self.inputs is not None:
            df = VectorSlicer(inputCol="features", outputCol=sliced, indices=self.inputs).transform(df)
        self.model.setFeaturesCol("features" if self.inputs is None else sliced).setPredictionCol(f"_{name}_p").setLeafCol(f"_{name}_l")
        out = self.model.transform(df)
        leaf = F.element_at(F.array(*[F.lit(float(v)) for v in self.leaves]), F.col(f"_{name}_l").cast("int") + 1)
        return out.withColumn(name, leaf).drop(sliced, f"_{name}_p", f"_{name}_l")


@dataclass
class Boosted:
    """The trees of a fitted model, by round and class, with the losses of every round that was run."""

    rounds: list[list[Tree]] = field(default_factory=list)
    base: float = 0.0
    classes: int = 1
    rate: float = 0.1
    history: list[tuple[int, float, float | None]] = field(default_factory=list)

    def margins(self, df: DataFrame, name: str = "margins") -> DataFrame:
        """Adds the margins of rows that have ``features``."""
        df = df.withColumn(name, F.array(*[F.lit(float(self.base))] * self.classes))
        for trees in self.rounds:
            df = self._add(df, trees, name)
        return df

    def _add(self, df: DataFrame, trees: Sequence[Tree], name: str) -> DataFrame:
        steps = [f"_step{k}" for k in range(len(trees))]
        for tree, step in zip(trees, steps, strict=True):
            df = tree.value(df, step)
        moved = F.array(*[F.col(name)[k] + F.lit(float(self.rate)) * F.col(step) for k, step in enumerate(steps)])
        return df.withColumn(name, moved).drop(*steps)

    def losses(self, spark: SparkSession) -> DataFrame:
        """round (from 1), train_loss, valid_loss of the rounds that were run, those after the best one included."""
        return spark.createDataFrame(self.history, "round int, train_loss double, valid_loss double")

    def importances(self, size: int) -> list[float]:
        total = [0.0] * size
        for tree in (t for trees in self.rounds for t in trees):
            places = tree.inputs if tree.inputs is not None else range(size)
            for i, v in zip(places, tree.model.featureImportances.toArray().tolist(), strict=True):
                total[i] += v
        whole = sum(total)
        return [v / whole for v in total] if whole else total

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"base": self.base, "classes": self.classes, "rate": self.rate, "history": self.history, "rounds": [[{"leaves": t.leaves, "inputs": t.inputs} for t in trees] for trees in self.rounds]}
        for r, trees in enumerate(self.rounds):
            for k, tree in enumerate(trees):
                tree.model.write().overwrite().save(f"{path}/round={r}/class={k}")
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        state = json.loads(spark.read.option("wholetext", True).text(f"{path}/state").first().value)
        made = lambda r, k, t: Tree(DecisionTreeRegressionModel.load(f"{path}/round={r}/class={k}"), t["leaves"], t["inputs"])
        rounds = [[made(r, k, t) for k, t in enumerate(trees)] for r, trees in enumerate(state["rounds"])]
        return cls(rounds, state["base"], state["classes"], state["rate"], [tuple(h) for h in state["history"]])


def _fit_tree(rows: DataFrame, k: int, h: dict, seed: int, size: int, total: float) -> Tree:
    """The tree of class ``k`` for rows with ``steps``; ``total`` is the sum of curvatures over all rows; the least sum a child must have is given to Spark as a share of it."""
    subsample, columns, inputs = float(h["subsample"]), float(h["colsample_bytree"]), None
    if columns < 1:
        inputs = sorted(random.Random(seed).sample(range(size), max(1, round(columns * size))))
    g, curve = F.col("steps")[k]["g"], F.col("steps")[k]["h"]
    sampled = rows.sample(fraction=subsample, seed=seed) if subsample < 1 else rows
    stepped = sampled.select("features", (F.col("weight") * g).alias("g"), (F.col("weight") * curve).alias("h")).filter("h > 0")
    target = stepped.withColumn("target", -F.col("g") / F.col("h"))
    used = "features"
    if inputs is not None:
        target, used = VectorSlicer(inputCol="features", outputCol="sliced", indices=inputs).transform(target), "sliced"
    total *= subsample
    learner = DecisionTreeRegressor(
        featuresCol=used,
        labelCol="target",
        weightCol="h",
        maxDepth=int(h["max_depth"]),
        minWeightFractionPerNode=min(0.499, float(h["min_child_weight"]) / total) if total else 0.0,
        minInfoGain=2 * float(h["gamma"]) / total if total else 0.0,
        leafCol="leaf",
        seed=seed,
    )
    model = learner.fit(target)
    sums = model.transform(target).groupBy("leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    leaves = [0.0] * (int(max((r.leaf for r in sums), default=0)) + 1)
    leaves += [0.0] * ((model.numNodes + 1) // 2 - len(leaves))
    for r in sums:
        leaves[int(r.leaf)] = -r.g / (r.h + LEAF_PENALTY)
    return Tree(model, leaves, inputs)


def boost(
    rows: DataFrame,
    objective: Objective,
    hyperparameters: dict,
    label: str = "label",
    weight: str = "example_weight",
    held_out: str | None = None,
    patience: int | None = None,
    seed: int = 42,
    cut_every: int = 1,
) -> Boosted:
    """Trees for rows with ``features``, a label and a weight. Rows with weight 0 count for nothing; a table without rows raises."""
    kept = [F.col("features"), F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight")]
    kept.append((F.col(held_out) if held_out else F.lit(False)).alias("held_out"))
    rows = rows.select(*kept)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_PER_TASK))
    rows = materialize(rows.repartition(tasks), "boost-rows")
    train, y = ~F.col("held_out"), F.col("label")
    mean = lambda v, which: F.sum(F.when(which, F.col("weight") * v)) / F.sum(F.when(which, F.col("weight")))
    first = rows.agg(mean(y, train).alias("mean")).first().mean
    if first is None:
        raise ValueError("there are no rows to train on")
    size = rows.first().features.size
    out = Boosted(base=objective.start(first), classes=objective.classes, rate=float(hyperparameters["learning_rate"]))
    stepped = lambda df: df.withColumns({"steps": objective.steps(y, F.col("margins")), "loss": objective.loss(y, F.col("margins"))})
    at = materialize(stepped(out.margins(rows)), "boost-margins")
    curves = [F.sum(F.when(train, F.col("weight") * F.col("steps")[k]["h"])).alias(f"h{k}") for k in range(objective.classes)]
    totals = at.agg(*curves).first()
    best, best_round = math.inf, 0
    for n in range(int(hyperparameters["n_estimators"])):
        learn = at.filter(train)
        trees = [
            _fit_tree(learn, k, hyperparameters, seed + n * objective.classes + k, size, totals[f"h{k}"] or 0.0)
            for k in range(objective.classes)
        ]
        out.rounds.append(trees)
        at = stepped(out._add(at.drop("steps", "loss"), trees, "margins"))
        if (n + 1) % cut_every == 0:
            at = materialize(at, "boost-margins")
        loss = F.col("loss")
        lost = totals = at.agg(mean(loss, train).alias("train"), mean(loss, ~train).alias("valid"), *curves).first()
        out.history.append((n + 1, lost.train, lost.valid))
        if held_out and lost.valid is not None:
            if lost.valid < best:
                best, best_round = lost.valid, n + 1
            elif patience is not None and n + 1 - best_round >= patience:
                break
    if held_out and patience is not None and best_round:
        out.rounds = out.rounds[:best_round]
    return out
