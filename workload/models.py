"""Training, scoring, evaluation and search."""

from pyspark.sql import functions as F

from tabflow.plans.columns import ColumnSpec
from tabflow.plans.dataset import Dataset
from tabflow.plans.evaluate import Evaluator, auc_frame, evaluate, evaluation_frame, passes
from tabflow.plans.model import Model, score
from tabflow.plans.search import search
from tabflow.session import materialize, scratch_path
from workload.registry import register, table

# ---------------------------------------------------------------- evaluation

_LABELS_SQL = """
WITH p AS (SELECT quality AS y, CASE WHEN (doc_id * 7) % 5 = 0 THEN 1 - quality ELSE quality END AS pred,
                  quality * 0.3 + ((doc_id * 37) % 101) / 101.0 AS s FROM labels),
t AS (SELECT count(*) FILTER (pred = 1 AND y = 1)::DOUBLE AS tp, count(*) FILTER (pred = 1) AS pp, count(*) FILTER (y = 1) AS ap,
             avg(CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM p)
"""


def _labelled(spark, sf):
    flip = (F.col("doc_id") * 7) % 5 == 0
    return table(spark, sf, "labels").select(
        F.col("quality").alias("y"),
        F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")).alias("pred"),
        (F.col("quality") * 0.3 + ((F.col("doc_id") * 37) % 101) / 101.0).alias("s"),
    )


@register(_LABELS_SQL + """
SELECT round(acc, 6) AS accuracy_score, round(tp / pp, 6) AS precision_score, round(tp / ap, 6) AS recall_score,
       round(2 * (tp / pp) * (tp / ap) / (tp / pp + tp / ap), 6) AS f1_score FROM t
""")
def v_classification(spark, sf):
    out = evaluation_frame(_labelled(spark, sf), "pred", "y", ["accuracy", "precision", "recall", "f1"])
    return out.select([F.round(c, 6).alias(c) for c in out.columns])


_PRICES_SQL = """
WITH p AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0 AS pred FROM lineitem)
SELECT l_returnflag, round(avg(abs(y - pred)), 4) AS mean_absolute_error, round(avg((y - pred) * (y - pred)), 2) AS mean_squared_error,
       round(sqrt(avg((y - pred) * (y - pred))), 4) AS root_mean_squared_error,
       round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2_score FROM p GROUP BY 1
"""


def _priced(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("pred"))


@register(_PRICES_SQL)
def v_regression(spark, sf):
    out = evaluation_frame(_priced(spark, sf), "pred", "y", ["mae", "mse", "rmse", "r2"], by=["l_returnflag"])
    places = {"mean_squared_error": 2, "r2_score": 6}
    return out.select("l_returnflag", *[F.round(c, places.get(c, 4)).alias(c) for c in out.columns[1:]])


@register("""
WITH s AS (SELECT l_discount + l_tax AS s, (l_quantity > 25)::INT AS y FROM lineitem),
g AS (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM s GROUP BY 1),
r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos::DOUBLE * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 8) AS auc FROM r
""")
def v_auc(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_discount") + F.col("l_tax")).alias("s"), (F.col("l_quantity") > 25).alias("y"))
    return auc_frame(rows, "s", "y").select(F.round("auc", 8).alias("auc"))


@register("""
WITH m AS (SELECT avg(abs(l_extendedprice - l_quantity * 1500.0)) AS mae FROM lineitem)
SELECT mae < 20000 AS below_20000, mae < 1 AS below_1, mae > 1 AS above_1 FROM m
""")
def v_gate(spark, sf):
    value = evaluate(_priced(spark, sf), "pred", "y", "regression", ["mae"])["mean_absolute_error"]
    row = (passes(value, 20000, "minimize"), passes(value, 1, "minimize"), passes(value, 1, "maximize"))
    return spark.createDataFrame([row], "below_20000 boolean, below_1 boolean, above_1 boolean")


class UnderPriced(Evaluator):
    """Two metrics at once: share and total of predictions below the truth."""

    direction = "minimize"

    def aggregates(self, pred, true):
        low = pred < true
        return {"share_low": F.round(F.avg(low.cast("double")), 6), "total_low": F.round(F.sum(F.when(low, true - pred)), 2)}


@register("""
SELECT l_returnflag, round(avg((l_quantity * 1500.0 < l_extendedprice)::INT), 6) AS share_low,
       round(sum(CASE WHEN l_quantity * 1500.0 < l_extendedprice THEN l_extendedprice - l_quantity * 1500.0 END), 2) AS total_low FROM lineitem GROUP BY 1
""")
def v_custom_evaluator(spark, sf):
    return evaluation_frame(_priced(spark, sf), "pred", "y", [], {"low": UnderPriced()}, by=["l_returnflag"])


# ---------------------------------------------------------------- training


def _split_by(key):
    bucket = F.pmod(F.xxhash64(key), F.lit(10))
    return F.when(bucket < 6, "train").when(bucket < 8, "valid").otherwise("test").alias("split")


DOCUMENT_INPUTS = ["n_chars", "n_words", "n_lines", "n_digits", "english"]


def document_rows(spark, sf):
    """Labels with features of the whole text."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("n_digits"),
        (F.col("lang") == "en").alias("english"),
    )
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", *DOCUMENT_INPUTS, "quality", _split_by("doc_id")
    )


def charge_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
        _split_by("l_orderkey"),
    )


_SMALL_TREES = {"n_estimators": 5, "max_depth": 3}


@register("""
SELECT doc_id, quality, true AS is_class, true AS sums_to_one, (SELECT count(*) FROM labels) > 0 AS as_good_as_majority
FROM labels JOIN documents USING (doc_id)
""")
def m_train_score_binary(spark, sf):
    """Every labelled document is scored once; over all rows the model is no worse than always naming the larger class."""
    rows = materialize(document_rows(spark, sf), "train")
    model = Model("classification", "quality", features=DOCUMENT_INPUTS, hyperparameters=_SMALL_TREES, early_stopping=True).fit(rows)
    scored = model.predict(rows)
    known = scored.agg(F.avg((F.col("prediction") == F.col("quality")).cast("double")).alias("right"), F.avg("quality").alias("ones")).first()
    return scored.select(
        "doc_id",
        "quality",
        F.col("prediction").isin(0, 1).alias("is_class"),
        _sums_to_one().alias("sums_to_one"),
        F.lit(known.right >= max(known.ones, 1 - known.ones) - 0.02).alias("as_good_as_majority"),
    )


def _sums_to_one():
    return F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-3


@register("SELECT vec_id, label % 3 AS label, true AS is_class, true AS sums_to_one FROM embeddings")
def m_train_score_multiclass(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 3).alias("label"), _split_by("vec_id"))
    rows = materialize(rows, "train")
    model = Model("classification", "label", "multi:softprob", features=["embedding"], hyperparameters={"n_estimators": 3, "max_depth": 3}).fit(rows)
    return model.predict(rows).select("vec_id", "label", F.col("prediction").isin(0, 1, 2).alias("is_class"), _sums_to_one().alias("sums_to_one"))


@register("""
SELECT count(*) AS num_rows, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) AS charge, true AS all_scored, true AS learned FROM lineitem
""")
def m_train_score_regression(spark, sf):
    """Few shallow trees explain most of the charge on rows they were not trained on."""
    rows = materialize(charge_rows(spark, sf), "train")
    model = Model("regression", "charge", hyperparameters={**_SMALL_TREES, "learning_rate": 0.5}).fit(rows)
    learned = model.evaluate(rows, "test", ["r2"])["r2_score"] > 0.5
    return model.predict(rows).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.round(F.sum("charge"), 0).alias("charge"),
        F.bool_and(F.col("prediction").isNotNull()).alias("all_scored"),
        F.lit(learned).alias("learned"),
    )


@register("SELECT true AS better_than_mean, true AS same_after_load, count(*) AS num_rows FROM lineitem")
def m_linear_saved(spark, sf):
    """A linear model explains the charge; saved and loaded it predicts the same."""
    rows = charge_rows(spark, sf)
    model = Model("regression", "charge", booster="gblinear", hyperparameters={"n_estimators": 10}).fit(rows)
    root = scratch_path(spark, "models")
    model.save(spark, root, "one")
    again = Model.load(spark, root, "one")
    r2 = model.evaluate(rows, "test", ["r2"])["r2_score"]
    both = again.predict(model.predict(rows).withColumnRenamed("prediction", "first"))
    return both.agg(
        F.lit(r2 > 0.5).alias("better_than_mean"),
        F.bool_and(F.abs(F.col("first") - F.col("prediction")) < 1e-9).alias("same_after_load"),
        F.count(F.lit(1)).alias("num_rows"),
    )


@register("SELECT 'reg:logistic' AS objective, true AS within_bounds, count(*) AS num_rows FROM lineitem UNION ALL SELECT 'binary:hinge', true, count(*) FROM labels")
def m_objectives(spark, sf):
    """Fractional targets by a logistic regression, and a hinge-loss classifier."""
    share = charge_rows(spark, sf).withColumn("share", F.col("l_quantity") / 60.0).drop("l_quantity")
    logistic = Model("regression", "share", "reg:logistic", "gblinear", {"lambda": 0.0}).fit(share)
    a = logistic.predict(share).agg(F.bool_and(F.col("prediction").between(0.0, 1.0)).alias("within_bounds"), F.count(F.lit(1)).alias("num_rows"))
    docs = materialize(document_rows(spark, sf), "train")
    hinge = Model("classification", "quality", "binary:hinge", "gblinear", {"n_estimators": 5}, features=DOCUMENT_INPUTS).fit(docs)
    b = hinge.predict(docs).agg(F.bool_and(F.col("prediction").isin(0, 1)).alias("within_bounds"), F.count(F.lit(1)).alias("num_rows"))
    return a.withColumn("objective", F.lit("reg:logistic")).unionByName(b.withColumn("objective", F.lit("binary:hinge")))


@register("""
SELECT feature, feature = 'l_extendedprice' AS is_first, true AS sums_to_one
FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) AS t(feature), (SELECT count(*) AS n FROM lineitem) WHERE n > 0
""")
def m_importances(spark, sf):
    rows = materialize(charge_rows(spark, sf), "train")
    found = Model("regression", "charge", hyperparameters=_SMALL_TREES).fit(rows).importances(spark)
    whole = found.agg(F.max("importance").alias("top"), F.sum("importance").alias("total")).first()
    return found.select("feature", (F.col("importance") == whole.top).alias("is_first"), F.lit(abs(whole.total - 1) < 1e-9).alias("sums_to_one"))


@register("""
SELECT 3::BIGINT AS trials, 1::BIGINT AS best_trials, true AS best_is_highest, true AS are_shares FROM (SELECT count(*) AS n FROM labels) WHERE n > 0
""")
def m_search_trials(spark, sf):
    ranges = {"n_estimators": {"min": 2, "max": 4}, "max_depth": {"min": 2, "max": 3}, "scale_pos_weight": 1, "subsample": 1.0, "colsample_bytree": 1.0}
    model = Model("classification", "quality", features=DOCUMENT_INPUTS, hyperparameters=_SMALL_TREES)
    result = search(document_rows(spark, sf), model, "accuracy_score", "maximize", n_trials=3, ranges=ranges)
    return result.trials.agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if("best").alias("best_trials"),
        (F.max("value") == F.max(F.when(F.col("best"), F.col("value")))).alias("best_is_highest"),
        F.bool_and(F.col("value").between(0.0, 1.0)).alias("are_shares"),
    )


def scoring_setup(spark, sf):
    """A fitted dataset and model for orders with NULLs; the priority is the input, the price the target."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        "o_totalprice",
    )
    dataset = Dataset(
        [
            ColumnSpec("o_orderkey", "integer", is_primary_key=True, hidden=True),
            ColumnSpec("o_custkey", "integer", training={"method": "median"}),
            ColumnSpec("o_orderpriority", "categorical", training={"method": "categorical", "encoding": "one_hot"}),
            ColumnSpec("o_totalprice", "float", is_target=True),
        ]
    )
    rows = orders.withColumn("split", _split_by("o_orderkey"))
    ready = materialize(dataset.fit(rows).normalize(rows), "ready")
    model = Model("regression", "o_totalprice", booster="gblinear", hyperparameters={"n_estimators": 5}, version="v1").fit(ready)
    return orders, dataset, model


@register("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS raw_customer, o_orderkey % 5 = 0 AS filled, true AS has_value, 'v1' AS model_version
FROM orders
""")
def m_scoring_job(spark, sf):
    """Raw input, normalised input, value and version in one row."""
    orders, dataset, model = scoring_setup(spark, sf)
    return score(orders.drop("o_totalprice"), dataset, model).select(
        F.col("raw_input.o_orderkey").alias("o_orderkey"),
        F.col("raw_input.o_custkey").alias("raw_customer"),
        F.col("normalized_input.o_orderpriority_other").alias("filled"),
        F.col("value").isNotNull().alias("has_value"),
        "model_version",
    )
