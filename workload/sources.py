"""Scans, schema unification and improvement, type inference, fingerprints, views."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.operators.stats import fit_statistics
from tabflow.session import scratch_path
from tabflow.sources import paths
from tabflow.sources.files import Source, convert_to_parquet, scan, scan_csv, scan_parquet
from tabflow.sources.manifest import Manifest
from tabflow.sources.schema import fingerprint, improve, infer_types, scan_unified
from workload.registry import half_up, register, table


@register("SELECT r_regionkey, r_name FROM region")
def s_file_subset(spark, sf):
    """The folder holds files of many schemas; the name filter opens one of them."""
    schema = table(spark, sf, "region").schema
    return scan_parquet(spark, sf, schema=schema, file_filter=lambda name: name == "region.parquet")


@register("SELECT count(*) AS num_rows, sum(l_quantity) AS quantity FROM lineitem")
def s_incremental_scan(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    rows = scan_parquet(spark, f"{sf}/lineitem.parquet", schema=schema, modified_after=dt.datetime(2000, 1, 1))
    return rows.agg(F.count(F.lit(1)).alias("num_rows"), F.sum("l_quantity").alias("quantity"))


@register("""
SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
       CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer
""")
def s_csv_null_tokens(spark, sf):
    """Written as CSV in two files with other column orders and three tokens for NULL, then read and inferred."""
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 12 == 0, "NULL").when(F.col("c_custkey") % 6 == 0, "\\N").otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(F.col("c_custkey") % 4 == 0, "\\\\N").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        "c_mktsegment",
    )
    path = scratch_path(spark, "csv")
    plain = {"header": True, "quote": "\u0000"}
    c.filter("c_custkey % 2 = 0").write.options(**plain).csv(f"{path}/even")
    c.filter("c_custkey % 2 = 1").select(*reversed(c.columns)).write.options(**plain).csv(f"{path}/odd")
    return scan_csv(spark, path)


def _two_files(spark, sf):
    """Suppliers with even keys as plain CSV, with odd keys compressed and in another column order; upper-case truth values."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 < 2, "TRUE").otherwise("FALSE").alias("flag"))
    path = scratch_path(spark, "csv")
    rows.filter("s_suppkey % 2 = 0").write.option("header", True).csv(path)
    rows.filter("s_suppkey % 2 = 1").select("flag", "s_suppkey", "s_name").write.mode("append").options(header=True, compression="gzip").csv(path)
    return path


@register("SELECT s_suppkey, s_name, s_suppkey % 4 < 2 AS flag FROM supplier WHERE s_suppkey % 2 = 1")
def s_csv_file_subset(spark, sf):
    rows = scan(spark, _two_files(spark, sf), format="csv", file_filter=lambda name: name.endswith(".gz"))
    return rows.select("s_suppkey", "s_name", "flag")


@register("SELECT s_suppkey, s_name, s_suppkey % 4 < 2 AS flag FROM supplier")
def s_csv_incremental(spark, sf):
    """Files changed after a date; none is newer than a date far ahead."""
    path, schema = _two_files(spark, sf), T.StructType([T.StructField("s_suppkey", T.LongType())])
    late = scan(spark, path, format="csv", schema=schema, modified_after=dt.datetime(2090, 1, 1))
    rows = scan(spark, path, format="csv", modified_after=dt.datetime(2000, 1, 1)).select("s_suppkey", "s_name", "flag")
    return rows.join(late.withColumnRenamed("s_suppkey", "late"), F.col("s_suppkey") == F.col("late"), "left_anti")


@register("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || '; ' || n_name AS n_name FROM nation")
def s_csv_separator(spark, sf):
    path = scratch_path(spark, "csv")
    name = F.concat("n_name", F.lit("; "), "n_name").alias("n_name")
    table(spark, sf, "nation").select("n_nationkey", name).write.options(header=True, sep=";", quote="'").csv(path)
    return Source(path=path, format="csv", options={"sep": ";", "quote": "'"}).read(spark)


@register("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, CAST(s_nationkey AS VARCHAR) AS s_nationkey, s_name FROM supplier")
def s_csv_to_parquet(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "supplier").drop("s_acctbal").write.option("header", True).csv(path)
    typed = {"s_suppkey": "float", "s_nationkey": "string", "s_name": "text"}
    return convert_to_parquet(scan_csv(spark, path, columns=typed), scratch_path(spark, "parquet"))


@register("""
SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(p_partkey AS VARCHAR) AS code FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_retailprice, p_name FROM part WHERE p_partkey % 2 = 1
""")
def s_schema_unify(spark, sf):
    """Two groups of files: long against double, long against string, and a column that only one group has."""
    part, path = table(spark, sf, "part"), scratch_path(spark, "unify")
    a = part.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), F.col("p_partkey").alias("code"), "p_brand")
    b = part.filter("p_partkey % 2 = 1").select("p_partkey", F.col("p_retailprice").alias("p_size"), F.col("p_name").alias("code"))
    a.write.parquet(f"{path}/a")
    b.write.parquet(f"{path}/b")
    return scan_unified(spark, path)


@register("""
SELECT o_orderkey, o_orderdate AS iso, o_orderdate AS us, o_orderdate AS month_name, strftime(o_orderdate, '%d.%m.%Y') AS unknown FROM orders
""")
def s_date_sniff(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    return improve(
        table(spark, sf, "orders").select(
            "o_orderkey",
            F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"),
            F.date_format(d, "MM/dd/yyyy").alias("us"),
            F.date_format(d, "MMM dd, yyyy").alias("month_name"),
            F.date_format(d, "dd.MM.yyyy").alias("unknown"),
        )
    )


@register("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, l_discount,
       CASE WHEN l_linenumber <> 3 THEN CAST(l_partkey AS BIGINT) END AS sparse FROM lineitem
""")
def s_improve_schema(spark, sf):
    sparse = F.when(F.col("l_linenumber") != 3, F.col("l_partkey").cast("double"))
    return improve(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", sparse.alias("sparse")))


@register("""
WITH v AS (
  SELECT 'lang' AS col, lang AS val FROM documents UNION ALL SELECT 'source', source FROM documents
  UNION ALL SELECT 'text', text FROM documents UNION ALL SELECT 'number', CAST(n_chars AS VARCHAR) FROM documents
  UNION ALL SELECT 'share', CAST(n_chars / 8.0 AS VARCHAR) FROM documents UNION ALL SELECT 'day', '2024-01-0' || (1 + doc_id % 7) FROM documents
  UNION ALL SELECT 'empty', NULL FROM documents),
k AS (SELECT col, val, count(*) AS n FROM v WHERE val IS NOT NULL GROUP BY 1, 2),
s AS (SELECT col, max(n) / sum(n) AS top_share, count(*) AS n_distinct, bool_and(TRY_CAST(val AS DOUBLE) IS NOT NULL) AS numeric_,
             bool_and(regexp_full_match(val, '[0-9]+')) AS whole, bool_and(TRY_CAST(val AS DATE) IS NOT NULL) AS dated FROM k GROUP BY 1)
SELECT col AS "column", CASE WHEN whole THEN 'integer' WHEN numeric_ THEN 'float' WHEN dated THEN 'datetime'
       WHEN top_share < 0.1 OR n_distinct > 100 THEN 'text' ELSE 'categorical' END AS semantic FROM s
UNION ALL SELECT 'empty', 'categorical'
""")
def s_semantic_type(spark, sf):
    docs = table(spark, sf, "documents").select(
        "lang",
        "source",
        "text",
        F.col("n_chars").cast("string").alias("number"),
        (F.col("n_chars") / 8).cast("string").alias("share"),
        F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 7 + 1).cast("string")).alias("day"),
        F.lit(None).cast("string").alias("empty"),
    )
    return spark.createDataFrame([(c, t) for c, (t, _) in infer_types(docs).items()], "column string, semantic string")


@register("""
SELECT name, n AS num_rows, same, differs FROM (VALUES ('orders', true, true)) AS t(name, same, differs), (SELECT count(*) AS n FROM orders)
""")
def s_fingerprint(spark, sf):
    """Equal for the same rows in another order, different after one value of one row changed."""
    orders = table(spark, sf, "orders")
    first = fingerprint(orders).first()
    moved = fingerprint(orders.repartition(7, "o_custkey")).first()
    changed = fingerprint(orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 3, 0.0).otherwise(F.col("o_totalprice")))).first()
    row = ("orders", first.num_rows, first.fingerprint == moved.fingerprint, first.fingerprint != changed.fingerprint)
    return spark.createDataFrame([row], "name string, num_rows long, same boolean, differs boolean")


@register("""
WITH v AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
SELECT 'orders' AS "column", count(*) AS num_rows, round(avg(orders), 4) AS mean, CAST(max(orders) AS DOUBLE) AS max FROM v
UNION ALL SELECT 'total', count(*), round(avg(total), 4), max(total) FROM v
""")
def s_view_then_stats(spark, sf):
    view = "SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {source} GROUP BY o_custkey"
    rows = Source(frame=table(spark, sf, "orders"), view=view).read(spark)
    s = fit_statistics(rows, ["orders", "total"], stats=("num_rows", "mean", "max"))
    out = [(c, v["num_rows"], half_up(v["mean"], 4), float(v["max"])) for c, v in s.columns.items()]
    return spark.createDataFrame(out, "column string, num_rows long, mean double, max double")


@register("""
WITH c AS (SELECT *, c_custkey % 5 AS part FROM customer)
SELECT 'first' AS run, 'added' AS change, count(*) AS num_rows, true AS as_whole FROM c WHERE part < 4
UNION ALL SELECT 'second', 'same', count(*), true FROM c WHERE part IN (0, 3)
UNION ALL SELECT 'second', 'replaced', count(*), true FROM c WHERE part = 1 AND c_custkey % 2 = 0
UNION ALL SELECT 'second', 'deleted', count(*), true FROM c WHERE part = 2
UNION ALL SELECT 'second', 'added', count(*), true FROM c WHERE part = 4
""")
def s_manifest_changes(spark, sf):
    """Four folders are read; then one gets other rows under its old file names, one goes and one comes. Only the new rows are read again."""
    customers = table(spark, sf, "customer")
    folder, new, root = (scratch_path(spark, n) for n in ("data", "rewritten", "manifest"))
    part = lambda k: customers.filter(F.col("c_custkey") % 5 == k)
    for k in range(4):
        part(k).write.parquet(f"{folder}/part{k}")
    manifest = Manifest(spark, folder, root, customers.schema)
    whole = lambda: fingerprint(spark.read.option("recursiveFileLookup", "true").schema(customers.schema).parquet(folder)).first() == manifest.fingerprint().first()
    out = [("first", r.change, r.n, whole()) for r in manifest.refresh().files.groupBy("change").agg(F.sum("num_rows").alias("n")).collect()]

    part(1).filter("c_custkey % 2 = 0").write.parquet(new)
    names = lambda p: sorted(r.path for r in paths.list_files(spark, p, "*.parquet").select("path").collect())
    old = names(f"{folder}/part1")
    for source, target in zip(names(new), old, strict=True):
        paths.replace(spark, source, target)
    paths.delete(spark, f"{folder}/part2")
    part(4).write.parquet(f"{folder}/part4")
    out += [("second", r.change, r.n, whole()) for r in manifest.refresh().files.groupBy("change").agg(F.sum("num_rows").alias("n")).collect()]
    return spark.createDataFrame(out, "run string, change string, num_rows long, as_whole boolean")


@register("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s_store_prefix(spark, sf):
    """Files below a prefix of a store that only Hadoop's file system interface reaches, in several folders."""
    kept = scratch_path(spark, "bucket")
    table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice").write.partitionBy("status").parquet(f"{kept}/orders")
    hadoop = spark._jsc.hadoopConfiguration()
    link = spark._jvm.org.apache.hadoop.fs.Path(kept).getFileSystem(hadoop).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(kept))
    bucket = kept.rstrip("/").split("/")[-1]
    hadoop.set(f"fs.viewfs.mounttable.{bucket}.link./data", link.toString())
    rows = Source(path=f"viewfs://{bucket}/data/orders").read(spark)
    status = F.regexp_extract(F.col("_metadata.file_path"), "status=([^/]+)/", 1)
    return rows.select("o_orderkey", status.alias("o_orderstatus"), "o_totalprice")
