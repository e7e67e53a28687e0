"""Train, validation and test rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.operators.split import SEGMENTS, DateSplitter, PredefinedSplitter, RandomSplitter, write_split
from tabflow.session import scratch_path
from tabflow.sources.paths import list_files
from workload.registry import register, table

_BOUNDS = """
WITH b AS (SELECT max(o_orderdate)::DATE - INTERVAL 6 MONTH AS test_start, max(o_orderdate)::DATE - INTERVAL 12 MONTH AS valid_start FROM orders),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS o_orderdate FROM orders),
s AS (SELECT o_orderkey, CASE WHEN o_orderdate < valid_start THEN 'train' WHEN o_orderdate < test_start THEN 'valid' ELSE 'test' END AS split
      FROM o, b)
"""


def _split(spark, sf):
    orders = table(spark, sf, "orders")
    dated = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")).alias("o_orderdate"))
    return DateSplitter("o_orderdate", months_test=6, months_valid=6).fit(orders).assign(dated)


@register(_BOUNDS + "SELECT split, count(*) AS num_rows FROM s GROUP BY split")
def p_date_split_counts(spark, sf):
    return _split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("num_rows"))


@register(_BOUNDS + "SELECT o_orderkey, split FROM s")
def p_date_split_rows(spark, sf):
    return _split(spark, sf).select("o_orderkey", "split")


@register("""
SELECT 'train' AS split, floor(count(*) * 0.6::DOUBLE)::BIGINT AS num_rows FROM orders
UNION ALL SELECT 'valid', floor(count(*) * 0.2::DOUBLE)::BIGINT FROM orders
UNION ALL SELECT 'test', count(*) - floor(count(*) * 0.6::DOUBLE)::BIGINT - floor(count(*) * 0.2::DOUBLE)::BIGINT FROM orders
""")
def p_random_split(spark, sf):
    rows = RandomSplitter(seed=7, key=["o_orderkey"]).assign(table(spark, sf, "orders"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("num_rows"))


@register("""
SELECT 'train' AS split, floor(count(*) * 0.5::DOUBLE)::BIGINT AS num_rows FROM lineitem
UNION ALL SELECT 'valid', floor(count(*) * 0.3::DOUBLE)::BIGINT FROM lineitem
UNION ALL SELECT 'test', count(*) - floor(count(*) * 0.5::DOUBLE)::BIGINT - floor(count(*) * 0.3::DOUBLE)::BIGINT FROM lineitem
""")
def p_random_split_without_key(spark, sf):
    rows = RandomSplitter(0.5, 0.3, 0.2).assign(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("num_rows"))


@register("""
SELECT 'train' AS split, c_custkey AS id FROM customer UNION ALL SELECT 'valid', s_suppkey FROM supplier UNION ALL SELECT 'test', p_partkey FROM part
""")
def p_file_split(spark, sf):
    keys = ("c_custkey", "s_suppkey", "p_partkey")
    schema = T.StructType([T.StructField(k, T.LongType()) for k in keys])
    rows = PredefinedSplitter(train=["customer"], valid=["supplier"], test=["part"]).read(spark, sf, schema=schema, format="parquet")
    return rows.select("split", F.coalesce(*keys).alias("id"))


@register(_BOUNDS + "SELECT o_orderkey, split FROM s")
def p_split_table(spark, sf):
    path = scratch_path(spark, "split")
    write_split(_split(spark, sf).select("o_orderkey", "split"), path)
    parts = [spark.read.parquet(path).filter(F.col("split") == name) for name in SEGMENTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("""
SELECT 'train' AS split, o_orderkey, CAST(o_custkey AS VARCHAR) AS code, CAST(o_custkey AS DOUBLE) AS amount FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'valid', o_orderkey, o_custkey || '.5', o_custkey + 0.5 FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT 'test', o_orderkey, 'x' || o_custkey, CAST(o_custkey AS DOUBLE) FROM orders WHERE o_orderkey % 3 = 2
""")
def p_csv_split_types(spark, sf):
    """A column of whole numbers in one file, fractions in the next, text in the last has one type over all of them."""
    root, key = scratch_path(spark, "split"), F.col("o_custkey").cast("string")
    orders, names = table(spark, sf, "orders"), {}
    codes = {"train": (key, key), "valid": (F.concat(key, F.lit(".5")),) * 2, "test": (F.concat(F.lit("x"), key), key)}
    for i, (name, (code, amount)) in enumerate(codes.items()):
        rows = orders.filter(F.col("o_orderkey") % 3 == i).select("o_orderkey", code.alias("code"), amount.alias("amount"))
        rows.coalesce(1).write.option("header", True).csv(f"{root}/{name}")
        found = list_files(spark, f"{root}/{name}", "*.csv").select("name").collect()
        names[name] = [r.name.removesuffix(".csv") for r in found]
    return PredefinedSplitter(**names).read(spark, root)
