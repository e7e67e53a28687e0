"""Boosting by objective and linear penalties, against closed forms.

A tree that is deep enough puts each value of one input into a leaf of its own, so a round adds rate * -G / (H + 1) to each value's
margin. The SQL repeats just that.
"""

from pyspark.sql import functions as F

from tabflow.plans.model import Model
from workload.registry import register, table

_SOFTMAX_SQL = """
WITH RECURSIVE rows_ AS (
  SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT AS priority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status FROM orders),
sizes AS (SELECT priority, count(*)::DOUBLE AS n, count(*) FILTER (status = 0) AS n0, count(*) FILTER (status = 1) AS n1, count(*) FILTER (status = 2) AS n2 FROM rows_ GROUP BY 1),
rounds AS (
  SELECT 0 AS round, *, 0.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2 FROM sizes
  UNION ALL
  SELECT round + 1, priority, n, n0, n1, n2, m0 - 0.3::DOUBLE * (n * p0 - n0) / (2 * n * p0 * (1 - p0) + 1), m1 - 0.3::DOUBLE * (n * p1 - n1) / (2 * n * p1 * (1 - p1) + 1),
         m2 - 0.3::DOUBLE * (n * p2 - n2) / (2 * n * p2 * (1 - p2) + 1)
  FROM (SELECT *, exp(m0) / (exp(m0) + exp(m1) + exp(m2)) AS p0, exp(m1) / (exp(m0) + exp(m1) + exp(m2)) AS p1, exp(m2) / (exp(m0) + exp(m1) + exp(m2)) AS p2 FROM rounds WHERE round < 4))
SELECT o_orderkey, (CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END)::INT AS prediction,
       round(exp(m0) / (exp(m0) + exp(m1) + exp(m2)), 4) AS p0, round(exp(m1) / (exp(m0) + exp(m1) + exp(m2)), 4) AS p1, round(exp(m2) / (exp(m0) + exp(m1) + exp(m2)), 4) AS p2
FROM rows_ JOIN rounds USING (priority) WHERE round = 4
"""


@register(_SOFTMAX_SQL)
def m_boosted_softmax(spark, sf):
    """One tree per class and round; the status of an order from its priority."""
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.alias("status"))
    h = {"n_estimators": 4, "max_depth": 4, "learning_rate": 0.3, "min_child_weight": 0}
    model = Model("classification", "status", "multi:softprob", features=["priority"], hyperparameters=h).fit(rows)
    return model.predict(rows).select("o_orderkey", "prediction", *[F.col("probabilities")[k].alias(f"p{k}") for k in range(3)])


@register("""
WITH RECURSIVE rows_ AS (SELECT o_custkey % 8 AS part, (o_totalprice > 100000 + 9000 * (o_custkey % 8))::INT AS dear FROM orders),
sizes AS (SELECT part, count(*) FILTER (dear = 1)::DOUBLE AS high, count(*) FILTER (dear = 0)::DOUBLE AS low FROM rows_ GROUP BY 1),
rounds AS (
  SELECT 0 AS round, *, 0.0::DOUBLE AS m FROM sizes
  UNION ALL
  SELECT round + 1, part, high, low, m + 0.3::DOUBLE * (CASE WHEN m < 1 THEN high ELSE 0 END - CASE WHEN m > -1 THEN low ELSE 0 END)
         / (CASE WHEN m < 1 THEN high ELSE 0 END + CASE WHEN m > -1 THEN low ELSE 0 END + 1) FROM rounds WHERE round < 5)
SELECT part::BIGINT AS part, (m > 0)::INT AS prediction, (high + low)::BIGINT AS num_rows, round(m, 6) AS margin FROM rounds WHERE round = 5
""")
def m_boosted_hinge(spark, sf):
    """Hinge loss by trees: margins of eight groups of customers."""
    part = F.col("o_custkey") % 8
    rows = table(spark, sf, "orders").select(part.alias("part"), (F.col("o_totalprice") > 100000 + 9000 * part).cast("int").alias("dear"))
    h = {"n_estimators": 5, "max_depth": 7, "learning_rate": 0.3, "min_child_weight": 0}
    model = Model("classification", "dear", "binary:hinge", features=["part"], hyperparameters=h).fit(rows)
    margins = model.boosted.margins(model.pipeline.transform(model.matrix(model.predict(rows).drop("probabilities"))))
    return margins.groupBy("part", "prediction").agg(F.count(F.lit(1)).alias("num_rows"), F.round(F.max(F.col("margins")[0]), 6).alias("margin"))


@register("""
WITH RECURSIVE rows_ AS (
  SELECT o_custkey % 8 AS part, (o_totalprice > 150000)::INT AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'valid' ELSE 'train' END AS split FROM orders),
start AS (SELECT ln(avg(y) / (1 - avg(y))) AS base FROM rows_ WHERE split = 'train'),
sizes AS (
  SELECT part, count(*) FILTER (split = 'train')::DOUBLE AS n, count(*) FILTER (split = 'train' AND y = 1)::DOUBLE AS ones,
         count(*) FILTER (split = 'valid')::DOUBLE AS vn, count(*) FILTER (split = 'valid' AND y = 1)::DOUBLE AS vones FROM rows_ GROUP BY 1),
rounds AS (
  SELECT 0 AS round, sizes.*, base AS m FROM sizes, start
  UNION ALL
  SELECT round + 1, part, n, ones, vn, vones, m - 1.0::DOUBLE * (n * p - ones) / (n * p * (1 - p) + 1) FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM rounds WHERE round < 20)),
losses AS (
  SELECT round, -sum(ones * ln(p) + (n - ones) * ln(1 - p)) / sum(n) AS train_loss, -sum(vones * ln(p) + (vn - vones) * ln(1 - p)) / sum(vn) AS valid_loss
  FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM rounds WHERE round > 0) GROUP BY round),
bests AS (
  SELECT *, (SELECT arg_min(b.round, b.valid_loss) FROM losses b WHERE b.round <= a.round) AS best FROM losses a),
ended AS (SELECT coalesce(min(round), 20) AS last FROM bests WHERE round - best >= 3)
SELECT round, round(train_loss, 8) AS train_loss, round(valid_loss, 8) AS valid_loss, (SELECT best FROM bests, ended WHERE round = last) AS kept_rounds
FROM bests, ended WHERE round <= last
""")
def m_boosted_patience(spark, sf):
    """The losses of every round; three rounds without a better loss on the valid rows end the boosting."""
    rows = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 8).alias("part"),
        (F.col("o_totalprice") > 150000).cast("int").alias("y"),
        F.when(F.col("o_orderkey") % 3 == 0, "valid").otherwise("train").alias("split"),
    )
    h = {"n_estimators": 20, "max_depth": 7, "learning_rate": 1.0, "min_child_weight": 0}
    model = Model("classification", "y", features=["part"], hyperparameters=h, patience=3).fit(rows)
    losses = model.boosted.losses(spark)
    return losses.select("round", F.round("train_loss", 8).alias("train_loss"), F.round("valid_loss", 8).alias("valid_loss"), F.lit(len(model.boosted.rounds)).alias("kept_rounds"))


@register("""
WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)
SELECT penalty::DOUBLE AS penalty, round(c / (v + penalty), 4) AS slope, round(my - mx * c / (v + penalty), 2) AS intercept FROM s, (VALUES (0), (10), (1000)) AS p(penalty)
""")
def m_linear_coefficients(spark, sf):
    """The price by quantity: least squares, and with a penalty of the squared slope a row."""
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    found = []
    for penalty in (0.0, 10.0, 1000.0):
        model = Model("regression", "price", booster="gblinear", hyperparameters={"lambda": penalty}).fit(rows)
        fitted = model.pipeline.stages[-1]
        found.append((penalty, float(fitted.coefficients[0]), float(fitted.intercept)))
    out = spark.createDataFrame(found, "penalty double, slope double, intercept double")
    return out.select("penalty", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))
