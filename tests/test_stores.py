import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabflow.operators.embed import Compressor, EmbeddingStore, embed_column, hashing_embedder
from tabflow.operators.inspect import same_rows
from tabflow.session import scratch_path
from tabflow.sources import store as store_module
from tabflow.sources.store import Store, append_csv, read_snapshot, snapshot_versions, write_snapshot
from tests.conftest import rows

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def test_first_values_stay(spark, scratch):
    store = Store(spark, scratch(), key="k")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "z"), (None, "n")], "k long, v string")
    store.append_new(first, order_by=["v"])
    store.append_new(spark.createDataFrame([(1, "x"), (3, "c"), (None, "m")], "k long, v string"))
    assert rows(store.read()) == [(None, "n"), (1, "a"), (2, "b"), (3, "c")]


@SLOW
@given(st.lists(st.lists(st.integers(0, 30), max_size=20), min_size=1, max_size=3))
def test_append_only_is_idempotent(spark, batches):
    store = Store(spark, scratch_path(spark, "store"), key="k")
    for n, keys in enumerate(batches + batches):
        store.append_new(spark.createDataFrame([(k, n) for k in keys], "k long, n int"))
    want = {}
    for n, keys in enumerate(batches):
        for k in keys:
            want.setdefault(k, n)
    assert {r.k: r.n for r in store.read().collect()} == want and store.read().count() == len(want)


def test_large_batches_are_anti_joined_by_shuffle(spark, scratch, monkeypatch):
    monkeypatch.setattr(store_module, "BROADCAST_BYTES", 0)
    store = Store(spark, scratch(), key="k")
    store.append_new(spark.range(100).withColumnRenamed("id", "k"))
    store.append_new(spark.range(50, 150).withColumnRenamed("id", "k"))
    assert sorted(r.k for r in store.read().collect()) == list(range(150))


def test_partitions_lookup_and_null_keys(spark, scratch):
    store = Store(spark, scratch(), key="ID", partition_size=10)
    df = spark.createDataFrame([(5, "a"), (15, "b"), (None, "c")], "ID long, t string")
    assert store.append(df).mode == "partitioned"
    assert {r.t: r.partition for r in store.read().collect()} == {"a": 1, "b": 2, "c": None}
    assert rows(store.between(4, 14)) == [(5, "a")]
    plan = store.between(4, 14)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(" in plan
    ranged = store.query(keys=(10, 19), select=["t"])
    assert "PartitionFilters: [(isnull(" in ranged._jdf.queryExecution().executedPlan().toString() and rows(ranged) == [("b",)]
    assert store.query(filter="ID = 15", select=["t"]).collect()[0].t == "b"
    assert rows(store.lookup(spark.createDataFrame([(15,), (15,)], "ID long"))) == [(15, "b")]


def test_rows_that_cannot_be_partitioned_stay_readable(spark, scratch, monkeypatch):
    store = Store(spark, scratch(), key="k", partition_size=10)
    store.append(spark.createDataFrame([(1.0, "a"), (12.0, "b")], "k double, t string"))
    result = store.append(spark.createDataFrame([(3.5, "c")], "k double, t string"))
    assert result.mode == "append" and "whole number" in result.reason
    monkeypatch.setattr(store_module, "FOLDERS", 5)
    result = store.append(spark.createDataFrame([(1.0, "d"), (500.0, "e")], "k double, t string"))
    assert result.mode == "partitioned"
    assert sorted(r.t for r in store.read().collect()) == list("abcde")
    assert sorted(r.t for r in store.between(0, 9).collect()) == ["a", "c", "d"]
    assert store.append(spark.createDataFrame([("f",)], "t string")).mode == "partitioned"
    assert store.read().filter("k is null").count() == 1


@pytest.mark.parametrize("size", [None, 7])
def test_compaction_keeps_the_rows_and_sorts_the_files(spark, scratch, size):
    store = Store(spark, scratch(), key="k", partition_size=size)
    for i in range(3):
        store.append(spark.range(i * 20, i * 20 + 30).select(F.col("id").alias("k"), F.lit(i).alias("v")))
    before = spark.createDataFrame(store.read().collect(), store.read().schema)
    store.compact(rows_per_file=25)
    assert same_rows(before, store.read())
    assert [n for n in os.listdir(store.path) if n.startswith("generation=")] == ["generation=000002"]
    files = store.read().withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list("k").alias("ks")).collect()
    assert all(list(r.ks) == sorted(r.ks) for r in files)
    store.append(spark.createDataFrame([(1000, 9)], "k long, v int"))
    assert store.read().count() == 91


def test_rows_without_a_key_are_cut_into_files(spark, scratch):
    store = Store(spark, scratch(), key="k", partition_size=10)
    store.append(spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), "id"))
    nulls = lambda: store.read().filter("k is null").select(F.input_file_name()).distinct().count()
    store.compact(rows_per_file=5_000)
    assert nulls() > 1 and store.read().count() == 40_000


def test_partitions_beyond_the_folders_still_prune(spark, scratch):
    store = Store(spark, scratch(), key="k", partition_size=1)
    store.append(spark.range(0, 100_010, 10).select(F.col("id").alias("k")))
    assert rows(store.between(50_000, 50_010)) == [(50_000,), (50_010,)]
    assert "PartitionFilters: [(isnull(" in store.between(50_000, 50_010)._jdf.queryExecution().executedPlan().toString()
    assert store.read().count() == 10_001


def test_other_schemas_and_known_keys(spark, scratch):
    store = Store(spark, scratch(), key="k")
    store.append_new(spark.createDataFrame([(1, "a")], "k long, v string"))
    with pytest.raises(ValueError, match="n long|n bigint"):
        store.append(spark.createDataFrame([(2, "b", 3)], "k long, v string, n long"))
    store.append(spark.createDataFrame([(2,)], "k long"))
    assert rows(store.read()) == [(1, "a"), (2, None)]
    before = sorted(os.listdir(store._current()))
    assert store.append_new(spark.createDataFrame([(1, "z")], "k long, v string")).mode == "skipped"
    assert sorted(os.listdir(store._current())) == before


def test_an_unfinished_generation_is_not_read(spark, scratch):
    store = Store(spark, scratch(), key="k")
    store.append(spark.range(3).withColumnRenamed("id", "k"))
    spark.range(1).withColumnRenamed("id", "k").write.parquet(f"{store.path}/generation=000002")
    os.remove(f"{store.path}/generation=000002/_SUCCESS")
    assert store.read().count() == 3


def test_named_empty_and_csv(spark, scratch):
    path = scratch()
    store = Store(spark, path)
    assert store.append(spark.range(0)).mode == "skipped" and store.is_empty()
    store.append_named(spark.range(2), "sub")
    assert Store(spark, f"{path}/sub").read().count() == 2
    csv = scratch()
    append_csv(spark.range(2), csv)
    append_csv(spark.range(2, 4), csv)
    assert sorted(r.id for r in spark.read.option("header", True).schema("id long").csv(csv).collect()) == [0, 1, 2, 3]


def test_snapshots(spark, scratch):
    root = scratch()
    write_snapshot(spark.range(1), root, "1")
    write_snapshot(spark.range(2), root, "2")
    assert snapshot_versions(spark, root) == ["1", "2"]
    assert read_snapshot(spark, root).count() == 2 and read_snapshot(spark, root, "1").count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        write_snapshot(spark.range(3), root, "1")


# ---------------------------------------------------------------- embeddings

NAMES = [(1, "John Smith"), (2, "John Smith"), (3, "Jane Doe"), (4, "Jane Doe"), (5, "Unique Person"), (6, None), (7, "")]


def test_distinct_texts_are_embedded_once(spark, scratch):
    log = scratch("log")
    os.makedirs(log)

    def embedder(texts):
        import uuid

        for t in texts:
            open(f"{log}/{t.replace(' ', '_')}-{uuid.uuid4()}", "w").close()
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame(NAMES, "id long, Name string")
    out = {r.id: r.Name_embedding for r in embed_column(df, "Name", embedder).collect()}
    assert out == {1: [10.0], 2: [10.0], 3: [8.0], 4: [8.0], 5: [13.0], 6: None, 7: None}
    assert sorted(n.split("-")[0] for n in os.listdir(log)) == ["Jane_Doe", "John_Smith", "Unique_Person"]


def test_store_keeps_the_first_vector_and_embeds_only_new_texts(spark, scratch):
    store = EmbeddingStore(spark, scratch())
    df = spark.createDataFrame(NAMES, "id long, Name string")
    store.update(df.filter("id <= 2"), "Name", lambda ts: [[1.0] for _ in ts])
    assert sorted(r.text for r in store.missing(df, "Name").collect()) == ["Jane Doe", "Unique Person"]
    store.update(df, "Name", lambda ts: [None if t == "Jane Doe" else [2.0] for t in ts])
    got = {r.id: r.Name_embedding for r in store.attach(df, "Name").collect()}
    assert got == {1: [1.0], 2: [1.0], 3: None, 4: None, 5: [2.0], 6: None, 7: None}
    store.compact()
    assert store.full.read().count() == 2


def test_missing_texts_are_counted_and_joined_by_key_alone(spark, scratch):
    import re

    store = EmbeddingStore(spark, scratch())
    df = spark.createDataFrame(NAMES, "id long, Name string")
    store.update(df.filter("id <= 2"), "Name", lambda ts: [[1.0] for _ in ts])
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    counted = store.missing(df, "Name").groupBy().count()
    assert counted.first()[0] == 2 and not re.search(r"(first\(|hashpartitioning\([^)]*|keys=\[[^]]*)\btext#", plan(counted))
    assert not re.search(r"hashpartitioning\([^)]*\btext#", plan(store.missing(df, "Name")))


def test_compression(spark, scratch):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 8))
    df = spark.createDataFrame([(bytes([i]), [float(x) for x in v]) for i, v in enumerate(base)], "text_key binary, embedding array<float>")
    pca = Compressor(variance=0.999).fit(df)
    assert pca.n_components <= 3
    small = {bytes(r.text_key): np.array(r.embedding) for r in pca.transform(df).collect()}
    a, b = bytes([3]), bytes([90])
    assert np.linalg.norm(small[a] - small[b]) == pytest.approx(np.linalg.norm(base[3] - base[90]), rel=0.05)
    assert Compressor(preset="space_efficient").fit(df).n_components == 6
    pca.save(scratch_path(spark, "pca"))
    store = EmbeddingStore(spark, scratch())
    store.full.append_new(df)
    store.compress(pca)
    assert store.compressed.read().count() == 200
    with pytest.raises(ValueError):
        Compressor(dimensions=3, preset="full")


def test_hashing_embedder_has_length_one():
    v = hashing_embedder(16)(["a b c a", ""])
    assert sum(x * x for x in v[0]) == pytest.approx(1) and v[1] == [0.0] * 16
