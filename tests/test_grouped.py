"""User functions by group: ranges of a hot group against the whole, groups without a key, nothing, features with a computed batch key."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabflow.operators.grouped import GroupFunction, apply_by_group
from tabflow.operators.history import cut_hot_groups, hot_groups
from tabflow.plans.features import Feature, FeatureError, FeatureList, build_batch
from tests.conftest import rows

SCHEMA = "g string, t long, v long"


def streak(schema="g string, t long, streak long"):
    """How many rows in a row had the value of this one."""
    names = [c.split()[0] for c in schema.split(", ")]

    def reduce(rows):
        last = rows["v"].iloc[-1]
        other = rows.index[rows["v"] != last]
        return {"v": int(last), "n": len(rows) - 1 - int(other.max()) if len(other) else len(rows), "whole": not len(other)}

    def merge(earlier, later):
        if later["whole"] and later["v"] == earlier["v"]:
            return {**later, "n": later["n"] + earlier["n"], "whole": earlier["whole"]}
        return {**later, "whole": False}

    def apply(rows, before):
        out, v, n = [], before and before["v"], before["n"] if before else 0
        for x in rows["v"]:
            v, n = x, n + 1 if x == v else 1
            out.append(n)
        return rows.assign(streak=out)[names]

    return GroupFunction(schema, apply, reduce, merge)


def plain(found):
    out = []
    for g in {r[0] for r in found}:
        v, n = None, 0
        for r in sorted((r for r in found if r[0] == g), key=lambda r: r[1]):
            v, n = r[2], n + 1 if r[2] == v else 1
            out.append((g, r[1], n))
    return sorted(out, key=str)


def test_hot_group_by_ranges_equals_the_whole(spark):
    found = [("hot" if i % 3 else None if i % 2 else f"g{i % 5}", i, i // 90 % 2) for i in range(900)]
    df = spark.createDataFrame(found[::-1], SCHEMA).repartition(4)
    for limit in (10_000, 250, 60):
        assert sorted(rows(apply_by_group(df, "g", ["t"], streak(), limit)), key=str) == plain(found), limit


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 1)), min_size=1, max_size=40), st.integers(3, 12))
def test_any_rows_and_limit(spark, given_rows, limit):
    found = [(g, t, v) for t, (g, v) in enumerate(given_rows)]
    assert sorted(rows(apply_by_group(spark.createDataFrame(found, SCHEMA), "g", ["t"], streak(), limit)), key=str) == plain(found)


def test_clashing_and_odd_names(spark):
    df = spark.createDataFrame([("a", 2, 1, 5), ("a", 1, 1, 6)], SCHEMA + ", `odd name` long")
    assert rows(apply_by_group(df, "g", ["t"], streak(), 1)) == [("a", 1, 1), ("a", 2, 2)]


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert apply_by_group(empty, "g", ["t"], streak()).isEmpty()
    with pytest.raises(ValueError):
        apply_by_group(empty, "g", [], streak())


class Streaks(Feature):
    name = "streaks"
    primary_key = "t"
    batch_key = "decade"
    batch_size = 1
    needs_columns = ("g", "v")
    group_function = streak()
    group_order = ("t",)

    def batch(self, df):
        return F.floor(F.col("t") / 10)


def test_feature_with_a_computed_batch_key(spark, scratch):
    feature = Streaks()
    feature.group_function = streak("t long, decade long, streak long")
    df = spark.createDataFrame([("x", t, 1) for t in range(25)], SCHEMA)
    features = FeatureList([feature])
    stores = features.stores(spark, scratch())
    features.fit(df, stores)
    assert [r.streak for r in stores["streaks"].read().orderBy("t").collect()] == [t % 10 + 1 for t in range(25)]
    assert {r.decade for r in stores["streaks"].query(keys=(1, 2)).collect()} == {1, 2}
    assert build_batch(df, feature, 1, 1).count() == 10


def test_a_computed_key_needs_a_name(spark, scratch):
    feature = Streaks()
    feature.batch_key = None
    with pytest.raises(FeatureError):
        FeatureList([feature]).fit(spark.createDataFrame([], SCHEMA), {"streaks": None})


def test_a_hot_group_is_not_cut_at_the_rows_of_others(spark):
    """Forty groups of one time axis: as many pieces as rows need, not groups times ranges, and none beyond the limit."""
    df = spark.range(8000).select((F.col("id") % 40).cast("string").alias("g"), F.col("id").alias("t"), F.lit(1).cast("long").alias("v"))
    hot = hot_groups(df, "g", 50)
    cut = cut_hot_groups(df, F.lit(True), "g", ["t"], hot, 50)
    found = cut.groupBy("g", "_range").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).collect()
    assert sum(r.n for r in found) == 8000 and max(r.n for r in found) <= 50
    assert len(found) <= 2 * 8000 // 50 + 2 * 40 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    for g in {r.g for r in found}:
        spans = [(r.low, r.high) for r in sorted((r for r in found if r.g == g), key=lambda r: r["_range"])]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
