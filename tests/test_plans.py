import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabflow.functions.columns import embedding_name
from tabflow.operators.embed import hashing_embedder
from tabflow.operators.encode import decode_values
from tabflow.operators.split import DateSplitter, RandomSplitter
from tabflow.plans.columns import ColumnSpec
from tabflow.plans.dataset import Dataset, decode_target
from tabflow.plans.evaluate import auc, evaluate, passes
from tabflow.plans.features import Feature, FeatureError, FeatureList, apply_feature
from tabflow.plans.model import Model, NotTrainable, score
from tabflow.plans.refresh import refresh
from tabflow.plans.search import draw, search
from tabflow.sources.files import Source
from tabflow.streaming.score import stream_normalize, stream_score
from tests.conftest import rows

# Eight loan rows: six before February 10th, one in March, one in June; two without annual revenue.
LOANS = [
    (1, 0, 300.0, "2024-01-01", "pay", False, "VA"),
    (2, 0, None, "2024-01-05", "pay", False, "CA"),
    (3, 9, 500.0, "2024-01-09", "exp", True, "VA"),
    (4, 7, 400.0, "2024-02-01", "exp", False, "VA"),
    (5, 0, 100.0, "2024-02-03", "pay", None, None),
    (6, 5, None, "2024-02-05", "pay", True, "TX"),
    (7, 3, 900.0, "2024-03-20", "new", False, "VA"),
    (8, 2, 800.0, "2024-06-10", None, True, "CA"),
]


def loans(spark):
    df = spark.createDataFrame(LOANS, "id long, rev long, annual double, d string, purpose string, flag boolean, state string")
    return df.withColumn("created", F.col("d").cast("timestamp_ntz")).drop("d")


class DidConvert(Feature):
    name = "did_convert"
    computes_columns = ("did_convert",)

    def transform(self, df, stored):
        return df.withColumn("did_convert", F.col("rev") > 0)


class StateSize(Feature):
    name = "state_size"
    primary_key = "state"
    needs_columns = ("id",)
    computes_columns = ("state_size",)

    def fit(self, df):
        return df.filter("state IS NOT NULL").groupBy("state").agg(F.count(F.lit(1)).alias("state_size"))

    def transform(self, df, stored):
        return df.join(stored.read(), "state", "left")


def columns(**changed):
    specs = {
        "id": dict(datatype="integer", is_primary_key=True),
        "rev": dict(datatype="integer", is_target=True),
        "annual": dict(datatype="float", training={"method": "median"}, inference={"method": "constant", "params": {"constant": -1}}),
        "purpose": dict(datatype="categorical", training={"method": "categorical", "params": {"categorical_min": 2}, "encoding": "one_hot"}),
        "flag": dict(datatype="boolean", training={"method": "most_frequent"}),
        "state": dict(datatype="categorical", training={"method": "most_frequent", "encoding": "ordinal"}),
        "created": dict(datatype="datetime", is_date_column=True, hidden=True),
        "state_size": dict(datatype="integer", computed_by="state_size", training={"method": "mean"}),
        "did_convert": dict(datatype="boolean", computed_by="did_convert"),
    }
    for name, more in changed.items():
        specs[name] = {**specs[name], **more}
    return [ColumnSpec(n, **s) for n, s in specs.items()]


def dataset(**options):
    return Dataset(columns(**options.pop("changed", {})), DateSplitter("created"), [StateSize(), DidConvert()], **options)


def test_split_normalise_and_mask(spark):
    df = loans(spark)
    d = dataset()
    split = d.split(df)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 6, "valid": 1, "test": 1}
    ready = d.fit(split).normalize(split)
    assert ready.columns == ["id", "rev", "annual", "purpose_exp", "purpose_pay", "purpose_other", "flag", "state", "state_size", "did_convert", "split"]
    got = {r.id: r for r in ready.collect()}
    # Training rows only: median of 300, 500, 400, 100; states CA, TX, VA; VA is the most frequent.
    assert got[2].annual == 350.0 and got[8].purpose_other is True and got[7].purpose_other is True and got[1].purpose_pay is True
    assert got[5].state == 2 and got[8].state == 0 and got[5].flag is False
    # The stored feature has no row for a missing state, which the mode fills before the join.
    assert got[5].state_size == 4 and got[3].did_convert is True and got[1].did_convert is False


def test_scoring_rows_need_neither_target_nor_all_columns(spark):
    df = loans(spark)
    d = dataset().fit(df)
    given = df.select("id", "annual", "purpose", "rev").filter("id IN (2, 3)")
    out = d.normalize(given, inference=True)
    assert "rev" not in out.columns and out.count() == 2
    assert {r.id: r.annual for r in out.collect()} == {2: -1.0, 3: 500.0}


def test_state_survives_saving(spark, scratch):
    df = loans(spark)
    d = dataset(root=scratch(), run_date=dt.date(2024, 7, 1)).fit(df)
    d.save(spark, f"{d.root}/state")
    again = Dataset.load(spark, f"{d.root}/state", [StateSize(), DidConvert()])
    split = d.split(df)
    assert rows(d.normalize(split)) == rows(again.normalize(split)) and again.run_date == dt.date(2024, 7, 1)


def test_other_splits_do_not_leak(spark):
    df = dataset().split(loans(spark))
    changed = df.withColumn("annual", F.when(F.col("split") == "train", F.col("annual")).otherwise(F.lit(1e9))).withColumn(
        "purpose", F.when(F.col("split") == "train", F.col("purpose")).otherwise(F.lit("leak"))
    )
    a, b = dataset().fit(df), dataset().fit(changed)
    train = df.filter("split = 'train'")
    assert rows(a.normalize(train)) == rows(b.normalize(train))


def test_drop_if_null_and_hidden_and_split_ys(spark):
    df = loans(spark)
    d = Dataset([ColumnSpec("id", "integer"), ColumnSpec("annual", "float", drop_if_null=True), ColumnSpec("rev", "integer", is_target=True)])
    assert d.normalize(df).count() == 6
    xs, ys = d.normalize(df, split_ys=True)
    assert xs.columns == ["id", "annual"] and ys.columns == ["rev"]
    assert dataset().hidden_columns() == ["created"]


def test_required_fields(spark):
    d = Dataset([ColumnSpec("id", "integer"), ColumnSpec("state", "string"), ColumnSpec("zip", "string", hidden=True), ColumnSpec("rev", "integer", is_target=True)])
    good, bad = d.check_required(loans(spark).drop("rev"))
    assert good.count() == 7 and [r.missing_fields for r in bad.collect()] == [["state"]]
    good, bad = d.check_required(loans(spark).drop("state"))
    assert good.count() == 0 and bad.count() == 8


def test_a_feature_without_a_value_when_scoring_is_imputed(spark, scratch):
    class Unknown(Feature):
        name = "unknown"
        computes_columns = ("later",)

        def transform(self, df, stored):
            return df.withColumn("later", F.col("annual") + 1) if "rev" in df.columns else df

    specs = [ColumnSpec("id", "integer"), ColumnSpec("annual", "float", training={"method": "mean"})]
    specs += [ColumnSpec("rev", "integer", is_target=True), ColumnSpec("later", "float", computed_by="unknown", training={"method": "mean"})]
    df = loans(spark).withColumn("split", F.lit("train"))
    d = Dataset(specs, features=[Unknown()]).fit(df)
    assert d.processed_statistics.get("later", "mean") == 501.0
    assert rows(d.normalize(df.select("id", "annual").filter("id = 3"), inference=True)) == [(3, 500.0, 501.0)]


def test_the_splitter_names_the_date_column_and_encoded_inputs_are_taken(spark):
    specs = [ColumnSpec("id", "integer"), ColumnSpec("created", "datetime"), ColumnSpec("state", "categorical", training={"method": "ffill", "encoding": "one_hot"})]
    d = Dataset(specs, DateSplitter("created")).fit(loans(spark))
    assert d.date_column == "created" and d.raw_statistics.get("state", "last_value") == "TX"
    given = spark.createDataFrame([(1, "true", "false", 0, 0)], "id long, state_CA string, state_TX string, state_VA int, state_other int")
    out = d.normalize(given, inference=True)
    assert rows(out.drop("created")) == [(1, True, False, False, False)] and "state" not in out.columns


def test_roles_and_steps_are_validated():
    with pytest.raises(ValueError, match="is_target"):
        Dataset([ColumnSpec("a", "float", is_target=True), ColumnSpec("b", "float", is_target=True)])
    with pytest.raises(ValueError, match="does not apply"):
        ColumnSpec("a", "boolean", training={"method": "mean"})
    with pytest.raises(ValueError, match="does not apply"):
        ColumnSpec("a", "float", training={"encoding": "one_hot"})
    with pytest.raises(ValueError, match="unknown datatype"):
        ColumnSpec("a", "money")


def test_embedding_encoding(spark, scratch):
    df = loans(spark).withColumn("split", F.lit("train"))
    d = Dataset(
        [ColumnSpec("id", "integer"), ColumnSpec("state", "text", training={"encoding": "embedding"})], embedders={"state": hashing_embedder(4)}, root=scratch()
    ).fit(df)
    out = d.normalize(df)
    assert out.columns == ["id", embedding_name("state"), "split"]
    by_id = {r.id: r.state_embedding for r in out.collect()}
    assert by_id[1] == by_id[3] and by_id[5] is None and len(by_id[2]) == 4
    new = spark.createDataFrame([(9, "NV")], "id long, state string")
    assert len(d.normalize(new, inference=True).first().state_embedding) == 4


def test_reduced_embeddings_in_batch_and_stream(spark, scratch):
    words = ["red", "green", "blue", "black", "white", "grey", "pink"]
    data = [(i, None if i == 5 else f"{words[i % 7]} {words[i % 5]}", "train" if i < 30 else "test") for i in range(40)]
    df = spark.createDataFrame(data, "id long, t string, split string")
    spec = ColumnSpec("t", "text", training={"encoding": "embedding", "params": {"dimensions": 3}})
    d = Dataset([ColumnSpec("id", "integer"), spec], embedders={"t": hashing_embedder(8)}, root=scratch()).fit(df)
    new = df.drop("split").union(spark.createDataFrame([(99, "violet")], "id long, t string"))
    batch = {r.id: r.t_embedding for r in d.normalize(new, inference=True).collect()}
    assert batch[5] is None and len(batch[99]) == 3 and batch[0] == batch[35] and len(batch) == 41
    source, out = scratch(), scratch()
    new.write.parquet(source)
    stream_normalize(spark.readStream.schema(new.schema).parquet(source), d, out, scratch()).awaitTermination()
    streamed = {r.id: r.t_embedding for r in spark.read.parquet(out).collect()}
    assert streamed.keys() == batch.keys()
    for k, v in batch.items():
        assert streamed[k] == (None if v is None else pytest.approx(v, abs=1e-5))


# ---------------------------------------------------------------- features


def test_feature_contract(spark):
    df = loans(spark)

    class NoFrame(Feature):
        name = "no_frame"

        def transform(self, df, stored):
            return "no frame"

    class Drops(Feature):
        name = "drops"

        def transform(self, df, stored):
            return df.drop("rev")

    class Multiplies(Feature):
        name = "multiplies"

        def transform(self, df, stored):
            return df.union(df)

    class Twice(Feature):
        name = "twice"
        primary_key = "state"

        def fit(self, df):
            return df.filter("state = 'VA'").select("state")

    for feature, message in ((NoFrame(), "DataFrame"), (Drops(), "removed"), (Multiplies(), "became")):
        with pytest.raises(FeatureError, match=message):
            apply_feature(df, feature, None, verify_rows=True)
    features = FeatureList([Twice()])
    with pytest.raises(FeatureError, match="more than once"):
        features.fit(df, features.stores(spark, "/tmp/never-written"))


def test_feature_order():
    def named(n):
        f = Feature()
        f.name = n
        return f

    fs = FeatureList([named("b")]).prepend(named("a")).insert(named("d")).insert_after("b", named("c")).insert_before("a", named("0"))
    assert [f.name for f in fs] == ["0", "a", "b", "c", "d"]
    with pytest.raises(FeatureError):
        fs.insert(named("a"))
    with pytest.raises(FeatureError):
        fs.insert_after("z", named("y"))


def test_all_fits_come_before_any_transform(spark, scratch):
    calls = []

    class Logged(Feature):
        def __init__(self, name):
            self.name = name

        def fit(self, df):
            calls.append(f"fit {self.name}")
            return df.select("id")

        def transform(self, df, stored):
            calls.append(f"transform {self.name}")
            return df

    d = Dataset([ColumnSpec("id", "integer")], features=[Logged("x"), Logged("y")], root=scratch())
    d.fit(loans(spark).withColumn("split", F.lit("train"))).normalize(loans(spark))
    assert calls == ["fit x", "fit y", "transform x", "transform y"]


# ---------------------------------------------------------------- evaluation


def test_metric_values(spark):
    reg = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "y double, p double")
    m = evaluate(reg, "p", "y", "regression")
    assert m["mean_absolute_error"] == 0.5 and m["mean_squared_error"] == 0.375
    assert m["root_mean_squared_error"] == pytest.approx(0.375**0.5) and m["r2_score"] == pytest.approx(0.9486, abs=1e-4)
    cls = spark.createDataFrame([(1, 1), (0, 0), (1, 1), (1, 0), (0, 0)], "y int, p int")
    m = evaluate(cls, "p", "y", "classification")
    assert (m["accuracy_score"], m["precision_score"], m["f1_score"]) == (0.8, 1.0, pytest.approx(0.8)) and m["recall_score"] == pytest.approx(2 / 3)


def test_metric_edges(spark):
    none = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    m = evaluate(none, "p", "y", "classification")
    assert m["precision_score"] == 0.0 and m["recall_score"] != m["recall_score"] and m["f1_score"] == 0.0
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert evaluate(flat, "p", "y", "regression", ["r2"])["r2_score"] == 1.0
    off = evaluate(flat.withColumn("p", F.lit(3.0)), "p", "y", "regression", ["r2"])["r2_score"]
    assert off != off
    bools = spark.createDataFrame([(True, True), (False, True)], "y boolean, p boolean")
    assert evaluate(bools, "p", "y", "classification", ["accuracy"])["accuracy_score"] == 0.5
    assert passes(1.0, 2.0, "minimize") and not passes(2.0, 2.0, "minimize") and passes(3.0, 2.0, "maximize") and not passes(float("nan"), 2.0, "maximize")
    with pytest.raises(ValueError):
        evaluate(flat, "p", "y", "regression", ["wrong"])


def test_auc_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(3000).select(
        (F.pmod(F.xxhash64("id"), F.lit(50)) / 50.0).alias("s"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) < 30).cast("double").alias("y")
    )
    df = df.withColumn("s", F.col("s") + F.col("y") * 0.2)
    want = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y").evaluate(df)
    assert auc(df, "s", "y") == pytest.approx(want, abs=1e-9)
    assert auc(df.filter("y = 1"), "s", "y") is None


# ---------------------------------------------------------------- models


def learnable(spark, n=400):
    x = (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x")
    df = spark.range(n).select("id", x, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(7)).cast("double").alias("noise"))
    df = df.withColumns({"y": (F.col("x") > 0.5).cast("int"), "cost": F.col("x") * 10 + 1, "kind": F.floor(F.col("x") * 3).cast("int"), "w": F.lit(1.0)})
    return RandomSplitter(key=["id"]).assign(df).drop("id")


def test_binary_classifier_learns_saves_and_ranks_inputs(spark, scratch):
    df = learnable(spark).select("x", "noise", "y", "split")
    m = Model("classification", "y", hyperparameters={"n_estimators": 3, "max_depth": 2}, early_stopping=True).fit(df)
    assert m.evaluate(df)["accuracy_score"] > 0.9
    p = m.predict(df).first()
    assert p.prediction in (0, 1) and sum(p.probabilities) == pytest.approx(1, abs=2e-4)
    importance = {r.feature: r.importance for r in m.importances(spark).collect()}
    assert importance["x"] > 0.9 and set(importance) == {"x", "noise"}
    root = scratch()
    m.save(spark, root, "7")
    assert rows(Model.load(spark, root, "7").predict(df)) == rows(m.predict(df))


def test_multiclass_probabilities(spark):
    df = learnable(spark).select("x", "noise", "kind", "split")
    m = Model("classification", "kind", "multi:softprob", hyperparameters={"n_estimators": 2, "max_depth": 2}).fit(df)
    out = m.predict(df)
    assert out.filter(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-3).isEmpty()
    assert m.evaluate(df, metrics=["accuracy"])["accuracy_score"] > 0.9
    linear = Model("classification", "kind", "multi:softmax", "gblinear", {"n_estimators": 20, "lambda": 0.0}).fit(df)
    assert linear.predict(df).select("prediction").distinct().count() == 3 and linear.importances(spark).count() == 2


def test_regression_and_weights(spark):
    df = learnable(spark).select("x", "noise", "cost", "w", "split")
    m = Model("regression", "cost", booster="gblinear", hyperparameters={"lambda": 0.0}, weight="w").fit(df)
    assert m.features == ["x", "noise"] and m.evaluate(df)["r2_score"] > 0.99


def test_rows_that_lack_inputs_are_scored_by_trees_and_left_open_by_linear_models(spark):
    df = learnable(spark, 200).select("x", "noise", "cost", "split").withColumn("v", F.array(F.col("x"), F.col("noise")))
    holes = df.select(F.lit(None).cast("double").alias("x"), "noise", F.lit(None).cast("array<double>").alias("v"))
    tree = Model("regression", "cost", hyperparameters={"n_estimators": 2, "max_depth": 2}).fit(df)
    assert tree.features == ["x", "noise", "v"] and [r.feature for r in tree.importances(spark).collect()] == ["x", "noise", "v_0", "v_1"]
    assert tree.predict(holes).filter(F.col("prediction").isNull() | F.isnan("prediction")).isEmpty()
    linear = Model("regression", "cost", booster="gblinear").fit(df)
    assert linear.predict(holes).filter(F.col("prediction").isNotNull()).isEmpty()


def test_what_cannot_be_trained(spark):
    df = learnable(spark, 60)
    with pytest.raises(ValueError, match="does not fit"):
        Model("classification", "kind", features=["x"]).fit(df)
    with pytest.raises(ValueError, match="does not fit"):
        Model("regression", "cost", "binary:logistic", features=["x"]).fit(df)
    with pytest.raises(NotTrainable, match="NULLs"):
        Model("regression", "cost", features=["x"]).fit(df.withColumn("x", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="weight"):
        Model("regression", "cost", weight="cost")
    with pytest.raises(ValueError, match="booster"):
        Model("regression", "cost", booster="dart")
    with pytest.raises(ValueError, match="unknown hyperparameters"):
        Model("regression", "cost", hyperparameters={"depth": 3})


def test_search_starts_from_the_given_parameters(spark):
    import numpy as np

    df = learnable(spark, 200).select("x", "noise", "cost", "split")
    model = Model("regression", "cost", booster="gblinear", hyperparameters={"n_estimators": 3, "lambda": 0.5})
    ranges = {"n_estimators": {"min": 2, "max": 5}}
    first, second = (search(df, model, "mean_squared_error", "minimize", n_trials=4, ranges=ranges) for _ in range(2))
    trials = {r.trial: r for r in first.trials.collect()}
    assert trials[0].hyperparameters["lambda"] == "0.5" and len(trials) == 4
    assert [r.trial for r in trials.values() if r.best] == [min(trials, key=lambda t: trials[t].value)]
    assert rows(first.trials.select("trial", "value")) == rows(second.trials.select("trial", "value"))
    rng = np.random.default_rng(0)
    assert draw(rng, 5) == 5 and draw(rng, {"options": ["a"]}) == "a" and 3 <= draw(rng, {"min": 3, "max": 4}) <= 4
    assert 0.001 <= draw(rng, {"min": 0.001, "max": 0.3, "log": True}) <= 0.3


def test_refresh_train_gate_score_and_stream(spark, scratch):
    """The whole way: source to snapshot, model, gate, batch scores and the same scores from a stream."""
    df = loans(spark)
    big = df.crossJoin(spark.range(20).select(F.col("id").alias("copy"))).withColumn("id", F.col("id") * 100 + F.col("copy")).drop("copy")
    source, root = scratch(), scratch()
    big.write.parquet(source)
    d = Dataset(columns(), DateSplitter("created"), [StateSize(), DidConvertWithoutRev()])
    done = refresh(spark, Source(path=source), d, root, "1")
    assert done.processed.count() == 160 and d.profile.get("annual", "null_count") == 0
    assert {r["split"] for r in done.raw.select("split").distinct().collect()} == {"train", "valid", "test"}
    model = Model("regression", "rev", booster="gblinear", hyperparameters={"n_estimators": 5}, version="1").fit(done.processed.drop("id"))
    assert model.gate(model.evaluate(done.processed), "mean_absolute_error", 1e6, "minimize")
    fresh = spark.read.parquet(source).drop("rev")
    batch = score(fresh, d, model)
    assert batch.columns == ["raw_input", "normalized_input", "value", "model_version"] and batch.count() == 160
    again = Dataset.load(spark, f"{root}/state/version=1", [StateSize(), DidConvertWithoutRev()])
    out = scratch()
    stream = spark.readStream.schema(fresh.schema).parquet(source)
    stream_score(stream, again, model, out, scratch()).awaitTermination()
    pick = lambda t: t.select("raw_input.id", F.round("value", 6))
    assert rows(pick(spark.read.parquet(out))) == rows(pick(batch))


class DidConvertWithoutRev(DidConvert):
    def transform(self, df, stored):
        return super().transform(df, stored) if "rev" in df.columns else df.withColumn("did_convert", F.lit(None).cast("boolean"))


def test_target_codes_are_decoded(spark):
    df = loans(spark).withColumn("split", F.lit("train"))
    d = Dataset([ColumnSpec("id", "integer"), ColumnSpec("purpose", "categorical", is_target=True, training={"method": "categorical", "encoding": "ordinal"})])
    coded = d.fit(df).normalize(df)
    assert {r.id: r.purpose for r in coded.collect()}[3] == 0
    assert decode_values([1, 0, 9], d.categories["purpose"]) == ["new", "exp", None]
    assert {r.id: r.purpose for r in decode_target(coded, d, "purpose").collect()}[3] == "exp"
