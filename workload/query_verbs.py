"""Filter, select, distinct, sort, cast, limit, batches, keys, nulls, comparison."""

from pyspark.sql import functions as F

from tabflow.operators.inspect import frame_diff, null_columns, null_report, primary_key, primary_key_candidates
from tabflow.operators.ordering import batch_bounds, key_batches
from tabflow.operators.query import column_view, features_and_target, query, sample_values, segment
from tabflow.operators.split import DateSplitter
from workload.registry import EVENTS_SQL, every, holed_events, register, table


@register("""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice > 100000 AND o_orderstatus = 'F'
ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100
""")
def q_filter_select_sort_limit(spark, sf):
    return query(
        table(spark, sf, "orders"),
        filter=(F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F"),
        select=["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"],
        sort=["o_totalprice", "o_orderkey"],
        descending=True,
        limit=100,
    )


@register("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_suppkey FROM lineitem")
def q_distinct_rows(spark, sf):
    return query(table(spark, sf, "lineitem"), select=["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], unique=True)


@register("""
SELECT event_id, CAST(trunc(value) AS BIGINT) AS value, TRY_CAST(event_type AS BIGINT) AS event_type,
       NULLIF(CASE WHEN event_id % 5 = 0 THEN '' ELSE props END, '') AS props
FROM events
""")
def q_cast_nonstrict(spark, sf):
    props = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("props"))
    return query(
        table(spark, sf, "events").withColumn("props", props),
        select=["event_id", "value", "event_type", "props"],
        cast={"value": "integer", "event_type": "integer", "absent": "float"},
    )


@register("""
SELECT doc_id, NULLIF(CASE WHEN lang = 'de' THEN '' ELSE lang END, '') AS lang, CAST(n_chars AS DOUBLE) AS n_chars
FROM documents WHERE CASE WHEN lang = 'de' THEN '' ELSE lang END <> 'fr'
""")
def q_empty_text_to_null(spark, sf):
    docs = table(spark, sf, "documents").withColumn("lang", F.when(F.col("lang") == "de", "").otherwise(F.col("lang")))
    return query(docs, filter=F.col("lang") != "fr", drop_cols=["text", "source", "absent"], cast={"n_chars": "float"})


@register("""
SELECT floor((rn - 1) / 1000)::BIGINT AS batch, min(o_orderkey) AS batch_start, max(o_orderkey) AS batch_end, count(*) AS num_rows
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey >= 100)
GROUP BY 1
""")
def q_key_batches(spark, sf):
    batched = key_batches(table(spark, sf, "orders"), "o_orderkey", 1000, start=100, filter=F.col("o_orderstatus") != "P")
    return batch_bounds(batched, "o_orderkey")


@register("""
SELECT l_orderkey, l_linenumber, floor((rk - 1) / 500)::BIGINT AS batch
FROM (SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_orderkey DESC) AS rk FROM lineitem)
""")
def q_key_batches_tied_descending(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return key_batches(lines, "l_orderkey", 500, descending=True)


@register("""
SELECT l_orderkey, l_linenumber, floor((rk - 1) / 2000)::BIGINT AS batch
FROM (SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_partkey END) AS rk FROM lineitem)
""")
def q_key_batches_hot_key(spark, sf):
    """A third of all rows share one key."""
    key = F.when(F.col("l_partkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_partkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("k"))
    return key_batches(lines, "k", 2000).drop("k")


@register("""
SELECT p_partkey, floor((rk - 1) / 100)::BIGINT AS batch
FROM (SELECT p_partkey, rank() OVER (ORDER BY p_name) AS rk FROM part)
""")
def q_key_batches_text(spark, sf):
    return key_batches(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 100).drop("p_name")


@register("""
SELECT col AS "column" FROM (
  SELECT 'o_orderkey' AS col, count(DISTINCT o_orderkey) = count(*) AS ok FROM orders
  UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) = count(*) FROM orders
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) = count(*) FROM orders
  UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice) = count(*) FROM orders
  UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate) = count(*) FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) = count(*) FROM orders
) WHERE ok
""")
def q_primary_key_candidates(spark, sf):
    return spark.createDataFrame([(c,) for c in primary_key_candidates(table(spark, sf, "orders"))], "column string")


@register("SELECT 'doc_id' AS \"column\" FROM documents HAVING count(DISTINCT doc_id) = count(*)")
def q_primary_key(spark, sf):
    return spark.createDataFrame([(primary_key(table(spark, sf, "documents")),)], "column string")


@register(EVENTS_SQL + """
SELECT col AS "column" FROM (
  SELECT 'event_type' AS col, count(*) FILTER (event_type IS NULL) AS n FROM ev
  UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM ev
  UNION ALL SELECT 'event_id', count(*) FILTER (event_id IS NULL) FROM ev
  UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL) FROM ev
  UNION ALL SELECT 'ts', count(*) FILTER (ts IS NULL) FROM ev) WHERE n > 0
""")
def q_null_columns(spark, sf):
    return spark.createDataFrame([(c,) for c in null_columns(holed_events(spark, sf))], "column string")


@register(EVENTS_SQL + """
SELECT split, 'event_type' AS "column", count(*) FILTER (event_type IS NULL) AS null_count,
       round(100.0::DOUBLE * count(*) FILTER (event_type IS NULL) / count(*), 1) AS null_percent FROM ev GROUP BY split
UNION ALL
SELECT split, 'value', count(*) FILTER (value IS NULL), round(100.0::DOUBLE * count(*) FILTER (value IS NULL) / count(*), 1) FROM ev GROUP BY split
""")
def q_null_percent_by_split(spark, sf):
    return null_report(holed_events(spark, sf))


@register("""
WITH changed AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 100 <> 1)
SELECT o_orderkey, 'changed' AS change, 'o_orderstatus' AS "column", o.o_orderstatus AS old_value, c.o_orderstatus AS new_value
FROM orders o JOIN changed c USING (o_orderkey) WHERE o.o_orderstatus IS DISTINCT FROM c.o_orderstatus
UNION ALL
SELECT o_orderkey, 'changed', 'o_custkey', CAST(o.o_custkey AS VARCHAR), CAST(c.o_custkey AS VARCHAR)
FROM orders o JOIN changed c USING (o_orderkey) WHERE o.o_custkey IS DISTINCT FROM c.o_custkey
UNION ALL
SELECT o_orderkey, 'removed', NULL, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changed)
""")
def q_frame_diff(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    changed = orders.filter(F.col("o_orderkey") % 100 != 1).select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        every(4, "o_custkey", "o_orderkey").alias("o_custkey"),
    )
    return frame_diff(changed, orders, ["o_orderkey"])


@register("""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, 'valid' AS split FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate)::DATE - INTERVAL 4 MONTH FROM orders)
  AND o_orderdate < (SELECT max(o_orderdate)::DATE - INTERVAL 2 MONTH FROM orders)
""")
def q_segment_hidden(spark, sf):
    rows = DateSplitter("o_orderdate").assign(table(spark, sf, "orders"))
    return segment(rows, "valid", hidden=["o_orderstatus", "o_orderpriority"])


@register("""
SELECT 'features' AS side, count(*) AS num_rows, 4::BIGINT AS num_columns, sum(c_custkey)::BIGINT AS total FROM customer
UNION ALL SELECT 'target', count(*), 1::BIGINT, sum(c_nationkey)::BIGINT FROM customer
""")
def q_features_and_target(spark, sf):
    xs, ys = features_and_target(table(spark, sf, "customer"), "c_nationkey")
    sides = (("features", xs, "c_custkey"), ("target", ys, "c_nationkey"))
    parts = [
        df.agg(F.count(F.lit(1)).alias("num_rows"), F.sum(c).cast("long").alias("total")).select(
            F.lit(name).alias("side"), "num_rows", F.lit(len(df.columns)).cast("long").alias("num_columns"), "total"
        )
        for name, df, c in sides
    ]
    return parts[0].unionByName(parts[1])


@register("SELECT p_brand, p_brand = 'Brand#1' AS \"p_brand_Brand#1\" FROM part")
def q_column_view(spark, sf):
    parts = table(spark, sf, "part").withColumn("p_brand_Brand#1", F.col("p_brand") == "Brand#1")
    return column_view(parts, "p_brand", ["p_brand_Brand#1", "p_brand_absent"])


@register(EVENTS_SQL + """
SELECT 'value' AS "column", least(5, count(value)) AS n FROM ev
UNION ALL SELECT 'event_type', least(5, count(event_type)) FROM ev
""")
def q_sample_values(spark, sf):
    found = sample_values(holed_events(spark, sf), ["value", "event_type"])
    return spark.createDataFrame([(c, sum(v is not None for v in vs)) for c, vs in found.items()], "column string, n long")


@register("SELECT 'events' AS name, count(*) AS num_rows, 6::BIGINT AS num_columns, count(*) = 0 AS is_empty FROM events")
def q_table_shape(spark, sf):
    events = table(spark, sf, "events")
    return events.agg(F.count(F.lit(1)).alias("num_rows")).select(
        F.lit("events").alias("name"), "num_rows", F.lit(len(events.columns)).cast("long").alias("num_columns"), (F.col("num_rows") == 0).alias("is_empty")
    )
