import datetime as dt
import decimal
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabflow.operators.encode import decode_column, encode_one_hot, encode_ordinal, explode_embedding
from tabflow.operators.history import Earlier, previous_value, with_earlier
from tabflow.operators.impute import Step, impute
from tabflow.operators.inspect import frame_diff, null_columns, null_report, primary_key, primary_key_candidates, same_rows
from tabflow.operators.ordering import batch_bounds, global_rank, key_batches, partition_bounds, running_total
from tabflow.operators.query import query, sample_values, segment
from tabflow.operators.split import DateSplitter, PredefinedSplitter, RandomSplitter
from tabflow.operators.stats import Categories, Statistics, exact_medians, fit_categories, fit_statistics, label_table
from tests.conftest import rows

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


# ---------------------------------------------------------------- query


def test_verbs_apply_in_the_fixed_order(spark):
    df = spark.createDataFrame([(1, "", 3.7), (2, "a", None), (3, "b", 1.2), (3, "b", 1.2)], "id long, s string, v double")
    out = query(df, filter=F.col("v").isNotNull(), select=["id", "s"], unique=True, sort="id", descending=True)
    assert [tuple(r) for r in out.collect()] == [(3, "b"), (1, None)]
    assert [tuple(r) for r in query(df, filter="s = ''", select=["s"]).collect()] == [(None,)]
    assert query(df, drop_cols=["s", "absent"]).columns == ["id", "v"]
    assert query(df, cast={"s": "integer"}, limit=2).count() == 2


def test_nulls_sort_first_in_both_directions(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "v long")
    assert [r.v for r in query(df, sort="v").collect()] == [None, 1, 2]
    assert [r.v for r in query(df, sort="v", descending=True).collect()] == [None, 2, 1]


def test_selecting_an_unknown_column_raises(spark):
    with pytest.raises(Exception, match="absent"):
        query(spark.range(1), select=["absent"])


def test_segment_and_samples(spark):
    df = spark.createDataFrame([(1, "train", None), (2, "test", 5)], "id long, split string, v long")
    assert rows(segment(df, "test", hidden=["v"])) == [(2, "test")]
    assert sample_values(df) == {"id": [1, 2], "split": ["train", "test"], "v": [5]}
    with pytest.raises(ValueError):
        segment(df, "other")


# ---------------------------------------------------------------- batches, ranks


def test_every_row_is_in_exactly_one_batch(spark):
    for n in (1, 2, 10, 11, 21):
        batched = key_batches(spark.range(n), "id", 10)
        assert batched.count() == n
        assert [r.num_rows for r in batch_bounds(batched, "id").orderBy("batch").collect()] == [10] * (n // 10) + ([n % 10] if n % 10 else [])


def _rank_rows():
    rng = random.Random(5)
    keys = [7 if rng.random() < 0.35 else rng.randrange(-50, 400) for _ in range(1200)]
    keys += [None] * 300
    return [(i, k, None if k is None else f"prefix/{k:05d}", None if k is None else k / 8) for i, k in enumerate(keys)]


@pytest.mark.parametrize("key", ["n", "t", "d"])
@pytest.mark.parametrize("descending", [False, True])
def test_global_rank_equals_the_single_task_window(spark, key, descending):
    df = spark.createDataFrame(_rank_rows(), "i int, n long, t string, d double").repartition(6, "i")
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
    want = df.select("i", (F.rank().over(Window.orderBy(order)) - 1).cast("long").alias("rank"))
    assert rows(global_rank(df, key, descending=descending, ranges=12).select("i", "rank")) == rows(want)


@pytest.mark.parametrize("key", ["n", "x", "t"])
def test_two_levels_of_ranges(spark, monkeypatch, key):
    from tabflow.operators import ordering

    monkeypatch.setattr(ordering, "LEVEL_RANGES", 5)
    df = spark.range(3000).select("id", ((F.col("id") * 37) % 1001).alias("n"), F.when(F.col("id") % 3 == 0, 7.5).otherwise(F.sqrt("id")).alias("x"), F.timestamp_seconds(F.col("id") % 500).alias("t"))
    df = df.withColumn(key, F.when(F.col("id") % 50 > 0, F.col(key)))
    for descending in (False, True):
        order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
        want = df.select("id", (F.rank().over(Window.orderBy(order)) - 1).cast("long").alias("rank"))
        assert rows(global_rank(df, key, descending=descending, ranges=400).select("id", "rank")) == rows(want)
    spread = ordering.assign_ranges(df.dropna().dropDuplicates([key]), key, "r", ranges=400).groupBy("r").count()
    assert spread.count() > 100 and spread.agg(F.max("count")).first()[0] < 60


def test_ranges_follow_the_rows_and_text_is_cut_by_whole_keys(spark, monkeypatch):
    from tabflow.operators import history, ordering

    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 100)
    urls = spark.range(4000).select(F.when(F.col("id") == 5, "a").otherwise(F.concat(F.lit("https://one.example/"), F.lpad(F.col("id").cast("string"), 9, "0"))).alias("k"), "id")
    for key in ("k", "id"):
        sizes = ordering.assign_ranges(urls, key, "r").groupBy("r").count()
        assert sizes.count() >= 30 and sizes.agg(F.max("count")).first()[0] <= 400
    cut = history._cut_groups(urls.withColumn("g", F.lit(1)), F.lit(True), ["k"], 40).groupBy("_range").count()
    assert cut.count() >= 30 and cut.agg(F.max("count")).first()[0] <= 400


def test_running_total_on_text_and_timestamps(spark):
    df = spark.range(500).select(
        F.concat(F.lit("https://www.example.org/a/b/"), F.sha2(F.col("id").cast("string"), 256)).alias("t"),
        F.timestamp_micros(F.col("id") * 1_000_003).cast("timestamp_ntz").alias("ts"),
        F.col("id"),
    )
    for key in ("t", "ts"):
        want = df.select(key, F.coalesce(F.sum("id").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        assert rows(running_total(df, key, {"before": F.col("id")}, ranges=7).select(key, "before")) == rows(want)


def test_partition_bounds(spark):
    df = spark.createDataFrame([(5,), (15,), (16,), (47,), (None,)], "k long")
    assert rows(partition_bounds(df, "k", 10)) == [(1, 0, 9, 1), (2, 10, 19, 2), (5, 40, 47, 1)]
    assert rows(partition_bounds(spark.createDataFrame([(-1,), (0,)], "k long"), "k", 10)) == [(0, -10, -1, 1), (1, 0, 0, 1)]


# ---------------------------------------------------------------- keys, nulls, diff


def test_primary_key(spark):
    df = spark.createDataFrame([(1, 10, "a"), (2, 20, "a")], "first long, row_id long, c string")
    assert primary_key_candidates(df) == ["first", "row_id"]
    assert primary_key(df) == "row_id"
    with pytest.raises(ValueError):
        primary_key(df.select("c"))


def test_nulls(spark):
    df = spark.createDataFrame([("train", 1, None), ("train", None, None), ("test", 3, 1)], "split string, a long, b long")
    assert null_columns(df) == ["a", "b"]
    assert rows(null_report(df)) == [("train", "a", 1, 50.0), ("train", "b", 2, 100.0)]


def test_frame_diff(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "id long, s string, v double")
    new = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (4, "d", 4.0)], "id long, s string, v double")
    assert rows(frame_diff(new, old, ["id"])) == [(1, "changed", "v", "1.0", "2.0"), (3, "removed", None, None, None), (4, "added", None, None, None)]
    no_key = spark.createDataFrame([(None, "n", 1.0)], "id long, s string, v double")
    assert frame_diff(new.union(no_key), new.union(no_key), ["id"]).isEmpty()
    assert rows(frame_diff(new.union(no_key), new, ["id"])) == [(None, "added", None, None, None)]
    assert same_rows(old, old.orderBy(F.desc("id"))) and not same_rows(old, new) and not same_rows(old, old.union(old))
    with pytest.raises(Exception, match="repeats"):
        frame_diff(old.union(old), old, ["id"]).collect()


# ---------------------------------------------------------------- splits


def test_date_split_boundaries(spark):
    days = ["2024-01-15", "2024-02-29", "2024-03-01", "2024-04-30", "2024-05-01", "2024-06-30 23:00:00", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("timestamp_ntz").alias("d"))
    out = [r.split for r in DateSplitter("d", 2, 2).assign(df).collect()]
    # The last date is June 30th: test from April 30th, validation from February 29th.
    assert out == ["train", "valid", "valid", "test", "test", "test", "test"]


def test_date_split_sniffs_text_and_uses_today_without_dates(spark):
    df = spark.createDataFrame([("01/02/2024",), ("05/20/2024",)], "d string")
    assert [r.split for r in DateSplitter("d").assign(df).collect()] == ["train", "test"]
    empty = spark.createDataFrame([], "d timestamp_ntz")
    assert DateSplitter("d", today=dt.datetime(2024, 5, 31, 7)).fit(empty).bounds == (dt.datetime(2024, 1, 31), dt.datetime(2024, 3, 31))
    with pytest.raises(TypeError):
        DateSplitter("d").fit(spark.createDataFrame([("x",)], "d string"))


@SLOW
@given(n=st.integers(1, 3000), seed=st.integers(0, 99))
def test_random_split_is_exact_stable_and_complete(spark, n, seed):
    df = spark.range(n)
    out = RandomSplitter(seed=seed, key=["id"]).assign(df)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert [counts.get(s, 0) for s in ("train", "valid")] == [int(n * 0.6), int(n * 0.2)]
    again = RandomSplitter(seed=seed, key=["id"]).assign(df.repartition(5, "id"))
    assert rows(out) == rows(again)


def test_random_split_spreads_copies_of_a_file_scan(spark, scratch):
    path = scratch()
    spark.range(4000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v")).write.parquet(path)
    out = RandomSplitter().assign(spark.read.parquet(path))
    assert out.columns == ["v", "split"]
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 2400, "valid": 800, "test": 800}
    assert out.filter("v = -1").select("split").distinct().count() == 3


def test_random_split_narrows_over_several_levels(spark, monkeypatch):
    from tabflow.operators import split

    monkeypatch.setattr(split, "_STEP_BITS", 4)
    monkeypatch.setattr(split, "_FEW_ROWS", 2)
    counts = RandomSplitter(key=["id"]).assign(spark.range(5000)).groupBy("split").count()
    assert {r["split"]: r["count"] for r in counts.collect()} == {"train": 3000, "valid": 1000, "test": 1000}


def test_random_split_by_threshold_and_validation(spark):
    out = RandomSplitter(key=["id"], exact=False).assign(spark.range(20000))
    share = out.filter("split = 'train'").count() / 20000
    assert abs(share - 0.6) < 0.01
    for bad in ((0.5, 0.5, 0.5), (1.0, 0.0, 0.0)):
        with pytest.raises(ValueError):
            RandomSplitter(*bad)


def test_predefined_split_validates_its_lists():
    with pytest.raises(ValueError):
        PredefinedSplitter(["a"], ["b"], [])
    with pytest.raises(ValueError):
        PredefinedSplitter(["a"], ["a"], ["c"])


# ---------------------------------------------------------------- statistics


def test_statistics_use_training_rows_after_clip(spark):
    df = spark.createDataFrame(
        [(1, "train", 5.0, "a"), (2, "train", 500.0, "b"), (3, "train", None, "b"), (4, "test", 900.0, "c")], "id long, split string, v double, g string"
    )
    s = fit_statistics(df, ["v", "g"], F.col("split") == "train", date_column="id", clips={"v": (0, 10)})
    assert s.get("v", "mean") == 7.5 and s.get("v", "median") == 7.5 and s.get("v", "max") == 10.0
    assert s.get("v", "num_rows") == 4 and s.get("v", "null_count") == 1 and s.get("v", "last_value") == 10.0
    assert s.get("g", "unique_count") == 3 and s.get("g", "most_frequent_value") == "b" and s.get("g", "last_value") == "b"
    assert Statistics.from_json(s.to_json()).columns == s.columns


def test_no_train_statistic_depends_on_other_rows(spark):
    base = [(i, "train" if i % 3 else "test", float(i % 7), f"g{i % 4}") for i in range(60)]
    moved = [r if r[1] == "train" else (r[0], r[1], 1e9, "leak") for r in base]
    schema = "id long, split string, v double, g string"
    a, b = (fit_statistics(spark.createDataFrame(x, schema), ["v", "g"], F.col("split") == "train", date_column="id") for x in (base, moved))
    for c in ("v", "g"):
        for stat in ("mean", "median", "min", "max", "std", "last_value", "most_frequent_value"):
            assert a.get(c, stat) == b.get(c, stat)


@SLOW
@given(
    st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([3.0, 3.0, -2.5])), min_size=1, max_size=400),
    st.integers(0, 300),
)
def test_median_by_narrowing_equals_the_definition(spark, values, copies):
    values = values + [3.0] * copies
    df = spark.createDataFrame([(v, int(v)) for v in values], "v double, w long")
    found = exact_medians(df, ["v", "w"], at_once=0, last_range=3, sketch=10)
    assert found["v"] == pytest.approx(statistics.median(values), abs=1e-9)
    assert found["w"] == statistics.median([int(v) for v in values])


def test_median_of_whole_numbers_beyond_doubles(spark):
    values = [2**60 + (k * 7) % 40 for k in range(200)] * 2 + [-(2**62), 2**62]
    df = spark.createDataFrame([(v, decimal.Decimal(v).scaleb(-2)) for v in values], "v long, d decimal(24,2)")
    found = exact_medians(df, ["v", "d"], at_once=0, last_range=3, sketch=10)
    assert found["v"] == float(statistics.median_low(values)) == exact_medians(df, ["v"])["v"]
    assert found["d"] == pytest.approx(float(decimal.Decimal(statistics.median_low(values)) / 100), rel=1e-15)


def test_ties_of_the_mode_go_to_the_first_text_at_any_length(spark):
    for texts in (["a" * 70 + str(k) for k in range(6)], ["b", "a" * 70, "c" * 80], ["b" * 70, "a"]):
        df = spark.createDataFrame([(t,) for t in texts * 2 + ["z" * 90, "y"]], "s string")
        assert fit_statistics(df, stats=("most_frequent_value",)).get("s", "most_frequent_value") == min(texts)


def test_mode_of_every_type_and_ties(spark):
    df = spark.createDataFrame(
        [(True, dt.date(2024, 1, 2), dt.datetime(2024, 1, 1, 5), "x" * 100), (True, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 5), "x" * 100), (None, None, None, "y")],
        "b boolean, d date, t timestamp_ntz, s string",
    )
    s = fit_statistics(df, stats=("most_frequent_value", "unique_count"))
    assert s.get("b", "most_frequent_value") is True
    assert s.get("d", "most_frequent_value") == dt.date(2024, 1, 1)
    assert s.get("t", "most_frequent_value") == dt.datetime(2024, 1, 1, 5)
    assert s.get("s", "most_frequent_value") == "x" * 100
    assert [s.get(c, "unique_count") for c in "bdts"] == [2, 3, 2, 2]


# ---------------------------------------------------------------- impute, encode

SIMPLE = [(1, "a", 3.0, True), (2, "a", 30.0, False), (3, "a", None, None), (4, "b", 5.0, True), (5, None, None, None)]
SIMPLE_SCHEMA = "id long, g string, v double, b boolean"


def test_imputers(spark):
    df = spark.createDataFrame(SIMPLE, SIMPLE_SCHEMA)
    stats = Statistics({"v": {"mean": 9.0, "median": 4.0, "last_value": 5.0, "most_frequent_value": 3.0}, "b": {"most_frequent_value": False}})
    fill = lambda step, c="v": [r[0] for r in impute(df, {c: step}, stats).orderBy("id").select(c).collect()]
    assert fill({"method": "mean"}) == [3.0, 30.0, 9.0, 5.0, 9.0]
    assert fill({"method": "median"}) == [3.0, 30.0, 4.0, 5.0, 4.0]
    assert fill({"method": "ffill"}) == [3.0, 30.0, 5.0, 5.0, 5.0]
    assert fill({"method": "constant", "params": {"constant": 0}}) == [3.0, 30.0, 0.0, 5.0, 0.0]
    assert fill({"method": "mean", "params": {"clip": {"min": 4, "max": 10}}}) == [4.0, 10.0, 9.0, 5.0, 9.0]
    assert fill({"method": "mean", "params": {"clip": False}}) == [3.0, 30.0, 9.0, 5.0, 9.0]
    # A learned false is a value, not an absent one.
    assert fill({"method": "most_frequent"}, "b") == [True, False, False, True, False]
    assert impute(df, {"absent": {"method": "mean"}}, stats).columns == df.columns


def test_clip_before_mean_makes_every_value_the_bound(spark):
    df = spark.createDataFrame([(float(v),) for v in (100, 200, 300)] + [(None,)], "v double")
    step = Step("mean", {"clip": {"min": 0, "max": 10}})
    stats = fit_statistics(df, ["v"], stats=("mean",), clips={"v": (0, 10)})
    assert [r[0] for r in impute(df, {"v": step}, stats).collect()] == [10.0] * 4


def test_rare_values_and_one_hot(spark):
    df = spark.createDataFrame(SIMPLE, SIMPLE_SCHEMA)
    cats = fit_categories(df, {"g": 3})
    assert cats["g"].values == ["a"]
    filled = impute(df, {"g": {"method": "categorical", "params": {"categorical_min": 3}}}, Statistics(), cats)
    assert [r.g for r in filled.orderBy("id").collect()] == ["a", "a", "a", "other", "other"]
    hot = encode_one_hot(filled, "g", cats["g"])
    assert [c for c in hot.columns if c.startswith("g_")] == ["g_a", "g_other"]
    assert all(r.g_a + r.g_other == 1 for r in hot.collect())
    unfilled = encode_one_hot(df, "g", cats["g"]).orderBy("id").collect()
    assert unfilled[3].g_a is False and unfilled[3].g_other is False and unfilled[4].g_a is None


def test_booleans_keep_their_values_and_sort_false_first(spark):
    df = spark.createDataFrame(SIMPLE, SIMPLE_SCHEMA)
    cats = fit_categories(df, {"b": 1})["b"]
    assert cats.values == [False, True]
    assert [c for c in encode_one_hot(df, "b", cats, categorical=False).columns if c.startswith("b_")] == ["b_false", "b_true"]
    assert [r.b for r in encode_ordinal(df, "b", cats).orderBy("id").collect()] == [1, 0, 2, 1, 2]
    assert [r.b for r in impute(df, {"b": {"method": "categorical"}}, Statistics(), {"b": cats}).orderBy("id").collect()] == [True, False, None, True, None]


@pytest.mark.parametrize("n", [5, 200, 1500])
def test_ordinal_and_decode_are_inverse_for_any_number_of_categories(spark, n):
    df = spark.range(n).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("c"), "id")
    cats = fit_categories(df, {"c": 1})["c"]
    assert cats.inline == (n <= Categories.MAX_INLINE)
    unseen = df.union(spark.sql("SELECT 'new', -1L UNION ALL SELECT NULL, -2L"))
    coded = encode_ordinal(unseen, "c", cats)
    assert {r.id: r.c for r in coded.collect()} == {**{i: i for i in range(n)}, -1: n, -2: n}
    back = decode_column(coded, "c", cats)
    assert {r.c for r in back.filter("id < 0").collect()} == {None}
    assert same_rows(back.filter("id >= 0"), df)
    if not cats.inline:
        hot = encode_one_hot(df, "c", cats)
        assert len(hot.columns) == n + 2 and hot.filter("c_v01001").count() == 1
        filled = impute(unseen, {"c": {"method": "categorical"}}, Statistics(), {"c": cats})
        assert filled.filter("c = 'other'").count() == 2 and filled.count() == n + 2


def test_label_table_orders_by_value(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("C", 3), ("é", 1)], "value string, count int")
    assert {r.value: r.label for r in label_table(df).collect()} == {"C": 0, "a": 1, "b": 2, "é": 3}


def test_embedding_columns(spark):
    df = spark.createDataFrame([(1, [0.5, 1.5]), (2, [2.5])], "id long, t_embedding array<float>")
    assert rows(explode_embedding(df, "t", 2)) == [(1, 0.5, 1.5), (2, 2.5, None)]
    assert explode_embedding(df, "t").columns == ["id", "t_embedding_0", "t_embedding_1"]


# ---------------------------------------------------------------- history


@pytest.mark.parametrize("hot_rows", [10**9, 40])
def test_earlier_rows_equal_the_plain_window(spark, hot_rows):
    rng = random.Random(3)
    group = lambda i: None if i % 19 == 0 else (1 if rng.random() < 0.4 else rng.randrange(2, 30))
    time = lambda i: None if i % 31 == 0 else rng.choice([5, 5, 5, rng.randrange(100)])
    data = [(i, group(i), time(i), rng.choice([None, 1.0, 2.0]), rng.random() < 0.3) for i in range(900)]
    df = spark.createDataFrame(data, "id long, k long, t long, v double, ok boolean").repartition(5, "id")
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "id",
        F.lag("v").over(Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "id")).alias("prev"),
        F.last(F.when(F.col("ok"), F.struct("t")), ignorenulls=True).over(w).getField("t").alias("last_ok"),
    )
    got = with_earlier(df, "k", ["t", "id"], {"prev": Earlier(F.col("v")), "last_ok": Earlier(F.col("t"), F.col("ok"))}, hot_rows)
    assert rows(got.select("id", "prev", "last_ok")) == rows(want)


def test_splitters_keep_no_cuts_that_nobody_fitted(spark):
    year = lambda y: spark.sql(f"SELECT explode(sequence(date'{y}-01-01', date'{y}-12-31')) AS d")
    splitter = DateSplitter("d")
    for y in (2023, 2024):
        assert {r.split: r["count"] for r in splitter.assign(year(y)).groupBy("split").count().collect()}["train"] > 200
    text = year(2024).select(F.date_format("d", "MM/dd/yyyy").alias("d"))
    fitted = DateSplitter("d").fit(text)
    assert fitted.format == "MM/dd/yyyy" and fitted.assign(text).filter("split = 'test'").count() == splitter.assign(year(2024)).filter("split = 'test'").count()
    random = RandomSplitter(key=["id"])
    for n in (100, 1000):
        assert {r.split: r["count"] for r in random.assign(spark.range(n)).groupBy("split").count().collect()} == {"train": n * 6 // 10, "valid": n // 5, "test": n // 5}


def test_earlier_rows_with_many_hot_groups(spark):
    df = spark.range(30_000).select((F.col("id") % 1500).alias("k"), "id")
    got = previous_value(df, "k", ["id"], "id", "prev", hot_rows=5)
    assert got.filter("prev <=> CASE WHEN id >= 1500 THEN id - 1500 END").count() == 30_000


def test_primary_key_candidates_in_one_shuffle(spark):
    """Long texts that differ at the end, a single NULL, two NULLs, an almost unique column, decimals and a constant."""
    df = spark.range(400).select(
        F.concat(F.repeat(F.lit("x"), 40), F.col("id").cast("string")).alias("long text"),
        F.when(F.col("id") > 0, F.col("id")).alias("one_null"),
        F.when(F.col("id") > 1, F.col("id")).alias("two_nulls"),
        F.when(F.col("id") == 7, 8).otherwise(F.col("id")).alias("near"),
        F.col("id").cast("decimal(12,2)").alias("d"),
        F.lit(1).alias("constant"),
    )
    assert primary_key_candidates(df) == ["long text", "one_null", "d"]
    assert primary_key_candidates(df.select("constant", "near")) == []


def test_ranked_rows_are_dealt_by_number_and_a_frequent_key_spreads(spark, monkeypatch):
    from tabflow.operators import ordering

    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 50)
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    for out in (key_batches(df, "k", 20), running_total(df, "id", {"before": F.lit(1)})):
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6000 and max(sizes) < 1000
