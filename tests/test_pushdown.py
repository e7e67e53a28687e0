"""What must reach the scan, and what must not appear in a plan."""

import os

import pytest
from pyspark.sql import functions as F

from tabflow.operators.inspect import same_rows
from tabflow.operators.lookup import lookup
from tabflow.operators.query import query
from tabflow.operators.split import DateSplitter
from tabflow.plans.columns import ColumnSpec
from tabflow.plans.dataset import Dataset

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    p = plan(query(spark.read.parquet(f"{SF}/orders.parquet"), filter=F.col("o_totalprice") > 5, select=["o_orderkey"]))
    assert "GreaterThan(o_totalprice,5.0)" in p and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_sort_with_limit_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(query(spark.read.parquet(f"{SF}/orders.parquet"), sort="o_totalprice", limit=5))


def test_one_segment_by_date_is_a_filter_of_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    splitter = DateSplitter("o_orderdate").fit(orders)
    assert "LessThan(o_orderdate" in plan(splitter.rows(orders, "train").select("o_orderkey"))
    parts = [splitter.rows(orders, s) for s in ("train", "valid", "test")]
    assert same_rows(parts[0].union(parts[1]).union(parts[2]), splitter.assign(orders))


def test_normalisation_is_one_generated_stage_without_shuffle_or_python(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("split", F.lit("train"))
    specs = [
        ColumnSpec("o_orderkey", "integer"),
        ColumnSpec("o_totalprice", "float", training={"method": "mean", "params": {"clip": {"min": 0, "max": 10}}}),
        ColumnSpec("o_orderpriority", "categorical", training={"method": "categorical", "encoding": "one_hot"}),
        ColumnSpec("o_orderstatus", "categorical", training={"method": "most_frequent", "encoding": "ordinal"}),
    ]
    p = plan(Dataset(specs).fit(orders).normalize(orders))
    assert "*(1)" in p and "*(2)" not in p
    assert not any(word in p for word in ("Exchange", "Python", "Join"))


def test_rows_without_a_key_are_spread_in_a_lookup(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 4000, 1, 16).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("k"), "id")
        known = spark.range(0, 4000, 8).select(F.col("id").alias("v"), (F.col("id") * 2).alias("w"))
        out = lookup(df, F.col("k"), known, "v")
        assert "hashpartitioning(_key" in plan(out) and "_spread" in plan(out).split("hashpartitioning(_key")[1][:60]
        assert same_rows(out, df.join(known, df.k == known.v, "left"))
        tasks = lookup(df.filter("k IS NULL"), F.col("k"), known, "v").groupBy(F.spark_partition_id()).count()
        assert tasks.count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
