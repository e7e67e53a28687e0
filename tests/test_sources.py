import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.types import SchemaConflict
from tabflow.operators.split import PredefinedSplitter, write_split
from tabflow.session import shared_folder
from tabflow.sources.files import Source, convert_to_parquet, scan, scan_csv, scan_parquet
from tabflow.sources.schema import convert_dates, fingerprint, improve, infer_types, scan_unified
from tests.conftest import rows


@pytest.fixture
def folder(scratch):
    path = scratch("files")
    os.makedirs(path)

    def write(name, text):
        full = os.path.join(path, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        opener = gzip.open if name.endswith(".gz") else open
        with opener(full, "wt") as f:
            f.write(text)
        return path

    return write


def test_csv_types_null_tokens_and_column_order(spark, folder):
    folder("one.csv", 'id,rev,name,made\n1,NULL,"a, b",2024-01-02T03:04:05.000000\n2,2.5,\\N,\n')
    path = folder("sub/two.csv.gz", "made,name,id,rev,extra\n2024-01-03T00:00:00.000000,c,3,4,x\n")
    df = scan_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "string", "timestamp_ntz"]
    assert rows(df) == [
        (1, None, "a, b", dt.datetime(2024, 1, 2, 3, 4, 5)),
        (2, 2.5, None, None),
        (3, 4.0, "c", dt.datetime(2024, 1, 3)),
    ]


def test_declared_types_keep_leading_zeros(spark, folder):
    path = folder("zips.csv", "ZIP,CITY\n00501,Holtsville\n10001,New York\n")
    assert scan_csv(spark, path, columns={"ZIP": "string"}).first().ZIP == "00501"
    assert scan_csv(spark, path).first().ZIP == 501


def test_parquet_wins_over_csv_and_files_are_read_recursively(spark, scratch):
    path = scratch()
    spark.range(3).write.parquet(f"{path}/a/b")
    spark.range(5).write.option("header", True).csv(f"{path}/c")
    assert scan(spark, path).count() == 3


def test_file_filter_and_incremental_scan(spark, scratch):
    path = scratch()
    spark.range(3).coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema
    name = next(n for n in os.listdir(path) if n.endswith(".parquet"))
    assert scan_parquet(spark, path, file_filter=lambda n: n == name).count() == 3
    assert scan_parquet(spark, path, file_filter=lambda n: n != name).count() == 0
    assert scan_parquet(spark, path, schema=schema, modified_after=dt.datetime(2000, 1, 1)).count() == 3
    assert scan_parquet(spark, path, schema=schema, modified_after=dt.datetime(2100, 1, 1)).count() == 0


def test_unify_widens_shared_columns(spark, scratch):
    path = scratch()
    spark.sql("SELECT 1L a, 2L b, true c, 'x' d").write.parquet(f"{path}/1")
    spark.sql("SELECT 'q' b, 1.5D a, true c").write.parquet(f"{path}/2")
    df = scan_unified(spark, path)
    assert rows(df) == [(1.0, "2", True), (1.5, "q", True)] and df.columns == ["a", "b", "c"]
    spark.sql("SELECT current_date() c").write.parquet(f"{path}/3")
    with pytest.raises(SchemaConflict, match="column c"):
        scan_unified(spark, path)


def test_improve(spark):
    df = spark.createDataFrame(
        [(1.0, 1.5, "2024-01-02", "2024-01-02", float("nan")), (None, 2.0, None, "no", 1.0)], "w double, f double, d string, s string, n double"
    )
    out = improve(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "double", "timestamp_ntz", "string", "double"]
    assert out.first().d == dt.datetime(2024, 1, 2)


def test_convert_dates_in_named_columns_only(spark):
    df = spark.createDataFrame([("2024-01-02", "2024-01-02"), (None, "2024-01-03")], "a string, b string")
    assert [f.dataType.simpleString() for f in convert_dates(df, ["a"]).schema.fields] == ["timestamp_ntz", "string"]
    assert convert_dates(df.select(F.lit(None).cast("string").alias("a"))).schema["a"].dataType == T.StringType()


def test_inference(spark):
    data = [(str(i), f"{i}.5", "true", "2024/01/%02d" % (i % 9 + 1), f"g{i % 3}", f"word {i}", None, "1" if i else "x") for i in range(120)]
    df = spark.createDataFrame(data, "i string, f string, b string, d string, c string, t string, n string, m string")
    found = {c: t for c, (t, _) in infer_types(df).items()}
    assert found == {"i": "integer", "f": "float", "b": "boolean", "d": "datetime", "c": "categorical", "t": "text", "n": "categorical", "m": "categorical"}


def test_fingerprint_sees_values_but_not_order(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "a long, b string")
    key = lambda d: fingerprint(d).first().fingerprint
    assert key(df) == key(df.orderBy(F.desc("a")))
    assert key(df) != key(df.filter("a = 2")) and key(df) != key(df.withColumn("b", F.coalesce("b", F.lit("")))) and key(df) != key(df.toDF("a", "c"))


def test_views(spark):
    df = spark.range(10)
    assert Source(frame=df, view=lambda d: d.filter("id > 7")).read(spark).count() == 2
    assert Source(frame=df, view="SELECT sum(id) AS s FROM {source}").read(spark).first().s == 45
    with pytest.raises(TypeError):
        Source(frame=df, view=lambda d: 3).read(spark)


def test_convert_to_parquet(spark, folder, scratch):
    path = folder("a.csv", "id,flag\n1,true\n2,TRUE\n")
    df = convert_to_parquet(scan_csv(spark, path, columns={"id": "integer", "flag": "string"}), scratch(), {"flag": "boolean"})
    assert rows(df) == [(1, True), (2, False)]


def test_predefined_files(spark, folder):
    folder("train_a.csv", "id\n1\n2\n")
    folder("valid.csv", "id\n3\n")
    path = folder("test.csv", "id\n4\n")
    out = PredefinedSplitter(["train_a"], ["valid"], ["test"]).read(spark, path)
    assert rows(out) == [(1, "train"), (2, "train"), (3, "valid"), (4, "test")]
    with pytest.raises(FileNotFoundError):
        PredefinedSplitter(["train_b"], ["valid"], ["test"]).read(spark, path)


def test_split_table_is_pruned(spark, scratch):
    path = scratch()
    write_split(spark.range(9).withColumn("split", F.when(F.col("id") < 6, "train").otherwise("test")), path)
    df = spark.read.parquet(path).filter("split = 'test'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and df.count() == 3


def test_scratch_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_null_type_columns_are_stored_as_text(spark, scratch):
    path = scratch()
    spark.sql("SELECT 1L a").write.parquet(f"{path}/1")
    out = convert_to_parquet(spark.sql("SELECT CAST(NULL AS STRING) a, 1 b"), scratch(), {"a": "null"})
    assert out.schema["a"].dataType == T.StringType()


def test_csv_options_filters_and_headers(spark, folder):
    folder("a.csv", "\ufeffa;b\n1;'x;y'\n2;TRUE\n")
    path = folder("b.csv", "b;c;a\nz;9;3\n")
    df = scan(spark, path, format="csv", sep=";", quote="'", file_column="_f").orderBy("a")
    assert [tuple(r) for r in df.collect()] == [(1, "x;y", "a.csv"), (2, "TRUE", "a.csv"), (3, "z", "b.csv")]
    only = scan(spark, path, format="csv", sep=";", file_filter=lambda n: n == "b.csv")
    assert only.columns == ["b", "c", "a"] and only.count() == 1
    with pytest.raises(FileNotFoundError):
        scan(spark, path, format="csv", sep=";", modified_after=dt.datetime(2090, 1, 1))


def test_truth_values_in_capitals_and_long_zone_names(spark, folder):
    path = folder("a.csv", "flag,at\nTRUE,2024-01-02 03:04:05.000000 America/Argentina/Buenos_Aires\nfalse,2024-01-03 03:04:05.000000 America/Argentina/Buenos_Aires\n")
    df = scan_csv(spark, path)
    assert dict(df.dtypes) == {"flag": "boolean", "at": "timestamp_ntz"} and sorted(r.flag for r in df.collect()) == [False, True]


def test_predefined_csv_files_are_typed_together(spark, folder):
    folder("one.csv", "v,w\n1,1\n")
    folder("two.csv", "w,v\n2.5,2.5\n")
    path = folder("three.csv", "v,w\nx,3\n")
    df = PredefinedSplitter(train=["one"], valid=["two"], test=["three"]).read(spark, path)
    assert {r.split: (r.v, r.w) for r in df.collect()} == {"train": ("1", 1.0), "valid": ("2.5", 2.5), "test": ("x", 3.0)}


def test_manifest_sees_what_times_do_not_show(spark, scratch):
    import pathlib

    from tabflow.sources.manifest import Manifest

    folder, root = scratch("data"), scratch("manifest")
    df = spark.range(40).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("v"))
    for k in range(3):
        df.filter(F.col("id") % 4 == k).coalesce(1).write.parquet(f"{folder}/p{k}")
    df.limit(0).coalesce(1).write.parquet(f"{folder}/empty")
    kept = Manifest(spark, folder, root, df.schema)
    assert kept.read().count() == 0 and kept.versions() == []
    first = kept.refresh()
    assert first.changed().agg(F.sum("num_rows")).first()[0] == 30
    whole = lambda: fingerprint(spark.read.option("recursiveFileLookup", "true").schema(df.schema).parquet(folder)).first()
    assert kept.fingerprint().first() == whole()

    again = kept.refresh()
    assert again.changed().isEmpty() and kept.fingerprint().first() == whole() and kept.versions() == [1, 2]

    # A file replaced by one with an older time, of other rows.
    old = next(pathlib.Path(f"{folder}/p1").glob("*.parquet"))
    df.filter("id % 4 = 3").coalesce(1).write.parquet(f"{folder}-other")
    other = next(pathlib.Path(f"{folder}-other").glob("*.parquet"))
    old.write_bytes(other.read_bytes())
    for crc in old.parent.glob(".*.crc"):
        crc.unlink()
    os.utime(old, (1_000_000_000, 1_000_000_000))
    found = {r.change: r.num_rows for r in kept.refresh().files.filter("change <> 'same'").collect()}
    assert found == {"replaced": 10} and kept.fingerprint().first() == whole()
    assert kept.fingerprint(1).first() != whole()


def test_manifest_of_many_changed_files_and_of_a_folder_that_empties(spark, scratch, monkeypatch):
    from tabflow.sources import manifest as module
    from tabflow.sources import paths
    from tabflow.sources.manifest import Manifest

    monkeypatch.setattr(module, "NAMED_FILES", 1)
    folder = scratch("data")
    df = spark.range(30)
    df.repartition(3).write.parquet(f"{folder}/a")
    kept = Manifest(spark, folder, scratch("manifest"), df.schema)
    assert kept.refresh().changed().agg(F.sum("num_rows")).first()[0] == 30
    assert kept.fingerprint().first() == fingerprint(spark.read.schema(df.schema).parquet(f"{folder}/a")).first()
    df.limit(0).write.parquet(f"{folder}/b")
    paths.delete(spark, f"{folder}/a")
    gone = kept.refresh().files.filter("change = 'deleted'").agg(F.sum("num_rows")).first()[0]
    assert gone == 30 and kept.fingerprint().first() == fingerprint(spark.read.schema(df.schema).parquet(folder + '/b')).first()


def test_only_changed_files_are_opened(spark, scratch):
    from tabflow.sources.manifest import Manifest, rows_of

    folder = scratch("data")
    df = spark.range(100)
    df.repartition(10).write.parquet(folder)
    kept = Manifest(spark, folder, scratch("manifest"), df.schema)
    one = kept.refresh().changed().limit(1)
    read = rows_of(spark, folder, one, df.schema)
    assert read.count() == one.first().num_rows and read.select("_file").distinct().count() == 1
    read.collect()
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1
