"""The boosting loop: better than the linear stand-in, patience, storage, parameters."""

import pytest
from pyspark.sql import functions as F

from tabflow.plans.model import Model, NotTrainable
from tests.conftest import rows

SMALL = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.5, "min_child_weight": 0}


@pytest.fixture(scope="module")
def crossed(spark):
    """Labels that follow from the side of both inputs together, so no sum of the two can tell them."""
    side = lambda c: (F.col(c) > 0.5).cast("int")
    number = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000.0
    df = spark.range(400).select("id", number(1).alias("x"), number(2).alias("z"), F.when(F.col("id") % 4 == 0, "valid").otherwise("train").alias("split"))
    # One side has fewer rows, so that greedy trees find a first split.
    df = df.filter("x < 0.5 OR z < 0.5 OR id % 3 > 0").withColumn("both", side("x").bitwiseXOR(side("z")))
    return df.withColumns({"kind": F.when(F.col("x") < 0.2, 2).otherwise(F.col("both")), "share": F.lit(0.1) + 0.8 * F.col("both")}).cache()


def right(model, df, target):
    return model.predict(df).agg(F.avg((F.col("prediction") == F.col(target)).cast("double"))).first()[0]


def test_hinge_and_softmax_beat_their_linear_stand_ins(crossed):
    for objective, target in (("binary:hinge", "both"), ("multi:softmax", "kind")):
        trees = Model("classification", target, objective, features=["x", "z"], hyperparameters=SMALL).fit(crossed)
        linear = Model("classification", target, objective if target == "both" else "multi:softmax", "gblinear", {"n_estimators": 20, "lambda": 0.0}, features=["x", "z"]).fit(crossed)
        assert right(trees, crossed, target) > max(0.9, right(linear, crossed, target) + 0.1)


def test_fractional_labels_and_storage(spark, crossed, scratch):
    h = {**SMALL, "n_estimators": 2, "subsample": 0.9, "colsample_bytree": 1.0}
    model = Model("regression", "share", "reg:logistic", features=["x", "z"], hyperparameters=h).fit(crossed)
    linear = Model("regression", "share", "reg:logistic", "gblinear", {"lambda": 0.0}, features=["x", "z"]).fit(crossed)
    off = lambda m: m.predict(crossed).agg(F.avg(F.abs(F.col("prediction") - F.col("share")))).first()[0]
    assert off(model) < 0.75 * off(linear)
    root = scratch()
    model.save(spark, root, "1")
    again = Model.load(spark, root, "1")
    assert rows(again.predict(crossed)) == rows(model.predict(crossed))
    assert sum(r.importance for r in again.importances(spark).collect()) == pytest.approx(1)


def test_patience_keeps_the_best_round(spark, crossed):
    noise = crossed.withColumn("y", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)).cast("int"))
    model = Model("classification", "y", features=["x", "z"], hyperparameters={**SMALL, "n_estimators": 8, "learning_rate": 1.0}, patience=1).fit(noise)
    losses = model.boosted.losses(spark)
    losses.createOrReplaceTempView("boosting_losses")
    best = spark.sql("SELECT min_by(round, valid_loss) FROM boosting_losses").first()[0]
    last = spark.sql("SELECT max(round) FROM boosting_losses").first()[0]
    assert len(model.boosted.rounds) == best and last in (best + 1, 8)


def test_inputs_of_a_tree_and_edge_cases(spark, crossed):
    model = Model("classification", "both", "binary:hinge", features=["x", "z"], hyperparameters={**SMALL, "n_estimators": 2, "colsample_bytree": 0.5}).fit(crossed)
    assert all(len(t.inputs) == 1 for trees in model.boosted.rounds for t in trees)
    holes = crossed.limit(3).withColumn("x", F.lit(None).cast("double"))
    assert model.predict(holes).filter("prediction IS NULL").isEmpty()
    with pytest.raises((ValueError, NotTrainable)):
        Model("classification", "both", "binary:hinge", features=["x", "z"], hyperparameters=SMALL).fit(crossed.filter("id < 0"))


def test_parameters_that_mean_nothing_are_refused():
    with pytest.raises(ValueError, match="unknown"):
        Model("regression", "share", booster="gblinear", hyperparameters={"learning_rate": 0.1})
    with pytest.raises(ValueError, match="rounds"):
        Model("regression", "share", booster="gblinear", patience=3)


def test_alpha_needs_a_model_that_has_it(crossed):
    with pytest.raises(ValueError, match="alpha"):
        Model("classification", "both", "binary:hinge", "gblinear", {"alpha": 1.0}, features=["x", "z"]).fit(crossed)


def test_a_round_computes_its_objective_once_on_rows_dealt_evenly(spark, crossed, monkeypatch):
    from tabflow.plans import boosting

    calls, written, softmax, materialize = [], [], boosting._softmax, boosting.materialize
    monkeypatch.setattr(boosting, "_softmax", lambda m: calls.append(1) or softmax(m))
    monkeypatch.setattr(boosting, "materialize", lambda df, name: written.append(materialize(df, name)) or written[-1])
    Model("classification", "kind", "multi:softmax", features=["x", "z"], hyperparameters={**SMALL, "n_estimators": 2}).fit(crossed.coalesce(1))
    assert len(calls) <= 2 * 3  # steps and loss, at the start and after each round
    files = written[0].select(F.input_file_name().alias("f")).distinct().count()
    assert files == spark.sparkContext.defaultParallelism
    odd = spark.createDataFrame([([1.0, 800.0, -3.0],), ([0.0],)], "m array<double>").select(softmax(F.col("m")).alias("p"))
    assert [r.p for r in odd.collect()] == [[0.0, 1.0, 0.0], [1.0]]
