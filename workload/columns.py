"""Column statistics, imputation and encoding."""

import datetime as dt

from pyspark.sql import functions as F

from tabflow.operators.encode import decode, encode_one_hot, encode_ordinal, explode_embedding
from tabflow.operators.impute import impute
from tabflow.operators.stats import Statistics, allowed_categories, category_counts, fit_categories, fit_statistics, label_table
from workload.registry import EVENTS_SQL, half_up, holed_events, register, table


def _in_train():
    return F.col("split") == "train"


@register("""
WITH v AS (SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
           UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS DOUBLE) FROM lineitem)
SELECT c AS "column", count(*) AS num_rows, count(*) - count(v) AS null_count, round(avg(v), 4) AS mean, median(v) AS median,
       min(v) AS min, max(v) AS max, round(stddev_samp(v), 4) AS std FROM v GROUP BY c
""")
def a_numeric_stats(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"]
    stats = ("num_rows", "null_count", "mean", "median", "min", "max", "std")
    s = fit_statistics(table(spark, sf, "lineitem").select(*names), names, stats=stats)
    rows = [
        (c, v["num_rows"], v["null_count"], half_up(v["mean"], 4), float(v["median"]), float(v["min"]), float(v["max"]), half_up(v["std"], 4))
        for c, v in s.columns.items()
    ]
    return spark.createDataFrame(
        rows, "column string, num_rows long, null_count long, mean double, median double, min double, max double, std double"
    )


@register(EVENTS_SQL + """
SELECT 'event_type' AS "column", (SELECT count(DISTINCT event_type) + 1 FROM ev) AS unique_count,
       (SELECT event_type FROM ev WHERE split = 'train' AND event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_frequent_value,
       (SELECT event_type FROM ev WHERE split = 'train' AND event_type IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_value
UNION ALL
SELECT 'user_id', NULL, (SELECT CAST(user_id AS VARCHAR) FROM ev WHERE split = 'train' GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
       (SELECT CAST(user_id AS VARCHAR) FROM ev WHERE split = 'train' ORDER BY ts DESC, event_id DESC LIMIT 1)
""")
def a_mode_last_value(spark, sf):
    stats = ("unique_count", "most_frequent_value", "last_value")
    s = fit_statistics(holed_events(spark, sf), ["event_type", "user_id"], _in_train(), stats, date_column="ts", tiebreak="event_id")
    rows = [(c, v.get("unique_count"), str(v["most_frequent_value"]), str(v["last_value"])) for c, v in s.columns.items()]
    return spark.createDataFrame(rows, "column string, unique_count long, most_frequent_value string, last_value string")


@register("""
SELECT 'source' AS "column", count(DISTINCT source) AS unique_count FROM documents
UNION ALL SELECT 'text', count(DISTINCT text) FROM documents UNION ALL SELECT 'lang', count(DISTINCT lang) FROM documents
""")
def a_unique_counts(spark, sf):
    """Whole texts are compared, long ones by their digest."""
    s = fit_statistics(table(spark, sf, "documents"), ["source", "text", "lang"], stats=("unique_count",))
    return spark.createDataFrame([(c, v["unique_count"]) for c, v in s.columns.items()], "column string, unique_count long")


@register("""
SELECT 'o_totalprice' AS "column", 'mean' AS stat, CAST(round(avg(o_totalprice), 2) AS VARCHAR) AS value FROM orders
UNION ALL SELECT 'o_totalprice', 'num_rows', CAST(count(*) AS VARCHAR) FROM orders
UNION ALL SELECT 'o_totalprice', 'null_count', '0'
UNION ALL SELECT 'o_orderstatus', 'num_rows', CAST(count(*) AS VARCHAR) FROM orders
UNION ALL SELECT 'o_orderstatus', 'null_count', '0'
UNION ALL SELECT 'o_orderstatus', 'unique_count', CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders
UNION ALL SELECT 'o_orderstatus', 'most_frequent_value', (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 'o_totalprice', 'most_frequent_value', (SELECT CAST(o_totalprice AS VARCHAR) FROM orders GROUP BY o_totalprice ORDER BY count(*) DESC, o_totalprice LIMIT 1)
""")
def a_profile(spark, sf):
    stats = ("num_rows", "null_count", "mean", "unique_count", "most_frequent_value")
    s = fit_statistics(table(spark, sf, "orders"), ["o_totalprice", "o_orderstatus"], stats=stats)
    rounded = Statistics({c: {k: half_up(x, 2) if k == "mean" else x for k, x in v.items()} for c, v in s.columns.items()})
    return rounded.to_frame(spark)


@register("SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1")
def a_category_counts(spark, sf):
    return category_counts(table(spark, sf, "customer"), "c_mktsegment")


@register("SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1 HAVING count(*) >= 30")
def a_allowed_categories(spark, sf):
    return allowed_categories(table(spark, sf, "part"), "p_name", 30)


@register("SELECT c_name AS value, row_number() OVER (ORDER BY c_name) - 1 AS label FROM (SELECT DISTINCT c_name FROM customer)")
def a_label_encoder(spark, sf):
    """As many categories as customers: numbered over ranges of the values, not in one task."""
    return label_table(allowed_categories(table(spark, sf, "customer"), "c_name"))


# ---------------------------------------------------------------- imputers


def _imputed(spark, sf, column, step, stat=None, run_date=None, clips=None):
    events = holed_events(spark, sf)
    stats = Statistics()
    if stat is not None:
        stats = fit_statistics(events, [column], _in_train(), (stat,), date_column="ts", tiebreak="event_id", clips=clips)
    return impute(events, {column: step}, stats, run_date=run_date).select("event_id", "split", column)


@register(EVENTS_SQL + "SELECT event_id, split, round(coalesce(value, (SELECT avg(value) FROM ev WHERE split = 'train')), 6) AS value FROM ev")
def e_mean(spark, sf):
    return _imputed(spark, sf, "value", {"method": "mean"}, "mean").withColumn("value", F.round("value", 6))


@register(EVENTS_SQL + "SELECT event_id, split, coalesce(value, (SELECT median(value) FROM ev WHERE split = 'train')) AS value FROM ev")
def e_median(spark, sf):
    return _imputed(spark, sf, "value", {"method": "median"}, "median")


@register(EVENTS_SQL + "SELECT event_id, split, coalesce(value, 12.5::DOUBLE) AS value FROM ev")
def e_constant(spark, sf):
    return _imputed(spark, sf, "value", {"method": "constant", "params": {"constant": "12.5"}})


@register(EVENTS_SQL + """
SELECT event_id, split, coalesce(value, (SELECT arg_max(value, ts) FROM ev WHERE split = 'train' AND value IS NOT NULL)) AS value FROM ev
""")
def e_ffill(spark, sf):
    return _imputed(spark, sf, "value", {"method": "ffill"}, "last_value")


@register(EVENTS_SQL + """
SELECT event_id, split, coalesce(event_type, (SELECT event_type FROM ev WHERE split = 'train' AND event_type IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM ev
""")
def e_most_frequent(spark, sf):
    return _imputed(spark, sf, "event_type", {"method": "most_frequent"}, "most_frequent_value")


@register("""
SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN ts END, TIMESTAMP '2024-03-01 00:00:00') AS ts FROM events
""")
def e_today(spark, sf):
    ts = F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts")
    rows = table(spark, sf, "events").select("event_id", ts)
    return impute(rows, {"ts": {"method": "today"}}, Statistics(), run_date=dt.date(2024, 3, 1))


@register(EVENTS_SQL + """
, c AS (SELECT event_id, split, CASE WHEN value IS NOT NULL THEN least(greatest(value, 10), 100) END AS value FROM ev)
SELECT event_id, split, round(coalesce(value, (SELECT avg(value) FROM c WHERE split = 'train')), 6) AS value FROM c
""")
def e_clip_then_mean(spark, sf):
    step = {"method": "mean", "params": {"clip": {"min": 10, "max": 100}}}
    return _imputed(spark, sf, "value", step, "mean", clips={"value": (10, 100)}).withColumn("value", F.round("value", 6))


_PART_SQL = """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 8 <> 0 THEN p_brand END AS p_brand, p_partkey % 10 < 6 AS is_train FROM part),
k AS (SELECT p_brand FROM p WHERE is_train AND p_brand IS NOT NULL GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 48 FROM p))
"""


def _brands(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 8 != 0, F.col("p_brand")).alias("p_brand"),
        (F.col("p_partkey") % 10 < 6).alias("is_train"),
    )
    least = -(-part.count() // 48)
    return rows, least


@register(_PART_SQL + "SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'other' END AS p_brand FROM p")
def e_categorical_other(spark, sf):
    rows, least = _brands(spark, sf)
    cats = fit_categories(rows, {"p_brand": least}, F.col("is_train"))
    return impute(rows, {"p_brand": {"method": "categorical", "params": {"categorical_min": least}}}, Statistics(), cats).drop("is_train")


# ---------------------------------------------------------------- encoders


@register("""
SELECT o_orderkey, v = '1-URGENT' AS "o_orderpriority_1_URGENT", v = '2-HIGH' AS "o_orderpriority_2_HIGH", v = '3-MEDIUM' AS "o_orderpriority_3_MEDIUM",
       v = '4-NOT SPECIFIED' AS "o_orderpriority_4_NOT SPECIFIED", v = '5-LOW' AS "o_orderpriority_5_LOW", v = 'other' AS "o_orderpriority_other"
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS v FROM orders)
""")
def n_one_hot(spark, sf):
    value = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").select("o_orderkey", value.alias("o_orderpriority"))
    cats = fit_categories(rows, {"o_orderpriority": 1})
    return encode_one_hot(rows, "o_orderpriority", cats["o_orderpriority"])


_ORDINAL_SQL = """
WITH k AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS label
           FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE'))
"""


@register(_ORDINAL_SQL + """
SELECT c_custkey, coalesce(label, (SELECT count(*) FROM k)) AS c_mktsegment FROM customer LEFT JOIN k ON v = c_mktsegment
""")
def n_ordinal(spark, sf):
    """FURNITURE is in no training row, so it gets the number after the last one."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    cats = fit_categories(rows, {"c_mktsegment": 1}, F.col("c_mktsegment") != "FURNITURE")
    return encode_ordinal(rows, "c_mktsegment", cats["c_mktsegment"])


@register("""
WITH k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS label FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS t FROM lineitem WHERE l_partkey % 5 <> 0))
SELECT l_orderkey, l_linenumber, coalesce(label, (SELECT count(*) FROM k)) AS part FROM lineitem LEFT JOIN k ON t = CAST(l_partkey AS VARCHAR)
""")
def n_ordinal_many(spark, sf):
    """More categories than a literal list may hold: labels come from a table that is joined."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    cats = fit_categories(rows, {"part": 1}, F.col("part").cast("long") % 5 != 0)
    return encode_ordinal(rows, "part", cats["part"])


@register("SELECT c_custkey, NULLIF(c_mktsegment, 'FURNITURE') AS c_mktsegment FROM customer")
def n_decode_roundtrip(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    cats = fit_categories(rows, {"c_mktsegment": 1}, F.col("c_mktsegment") != "FURNITURE")["c_mktsegment"]
    coded = encode_ordinal(rows, "c_mktsegment", cats)
    return coded.select("c_custkey", decode(F.col("c_mktsegment"), cats).alias("c_mktsegment"))


@register("SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}] AS vec_embedding_{i}" for i in range(64)) + " FROM embeddings")
def n_embedding_explode(spark, sf):
    """All elements; the width is that of the longest vector."""
    return explode_embedding(table(spark, sf, "embeddings"), "vec", source="embedding")
