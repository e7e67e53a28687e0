"""Earlier values across micro-batches: late and repeated micro-batches, merged versions, rows without a group, nothing at all."""

import pytest
from pyspark.sql import functions as F

from tabflow.operators.history import Earlier, with_earlier
from tabflow.sources import paths
from tabflow.streaming.batches import KeyedState, stream_batches
from tests.conftest import rows

SCHEMA = "g string, t long, v long, bought boolean"


def values():
    return {"before": Earlier(F.col("v")), "bought_v": Earlier(F.col("v"), F.col("bought"))}


def state_at(spark, path, **options):
    return KeyedState(spark, path, "g", ["t"], values(), **options)


def make(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def test_late_rows_get_what_is_still_known(spark, scratch):
    state = state_at(spark, scratch())
    state.prime(make(spark, [("a", 1, 10, True), ("a", 5, 50, False), ("b", 4, 40, False)]))
    out = state.follow(make(spark, [("a", 7, 70, False), ("a", 3, 30, False), ("a", 5, 55, False), ("c", 1, 1, True)]), 0)
    assert rows(out.select("g", "t", "v", "before", "bought_v", "is_late")) == rows(
        spark.createDataFrame(
            [("a", 7, 70, 55, 10, False), ("a", 3, 30, None, 10, True), ("a", 5, 55, 50, 10, False), ("c", 1, 1, None, None, False)],
            "g string, t long, v long, before long, bought_v long, is_late boolean",
        )
    )


def test_a_late_row_does_not_replace_a_newer_one(spark, scratch):
    state = state_at(spark, scratch())
    state.follow(make(spark, [("a", 9, 90, True)]), 0)
    state.follow(make(spark, [("a", 2, 20, True)]), 1)
    out = state.follow(make(spark, [("a", 10, 100, False)]), 2).first()
    assert (out.before, out.bought_v, out.is_late) == (90, 90, False)


def test_a_repeated_micro_batch_gives_the_same_rows(spark, scratch):
    state = state_at(spark, scratch())
    state.follow(make(spark, [("a", 1, 10, True), (None, 1, 5, False)]), 0)
    batch = make(spark, [("a", 2, 20, True), (None, 2, 6, True)])
    once, again = rows(state.follow(batch, 1)), rows(state.follow(batch, 1))
    assert once == again
    assert {(r[0], r[4]) for r in once} == {("a", 10), (None, 5)}


def test_merged_versions_replace_old_ones_and_keep_the_state(spark, scratch):
    path = scratch()
    state, plain = state_at(spark, path, merge_every=2), []
    state.prime(make(spark, [("a", 0, 0, True), ("b", 0, 1, False)]))
    for n in range(6):
        plain += [("a", 2 * n + 1, n, n % 2 == 0), ("b", 2 * n + 2, -n, n == 3)]
        state.follow(make(spark, plain[-2:]), n)
        state.prime(make(spark, [("a", 99, 99, True)]))
    assert paths.child_folders(spark, f"{path}/merged") == ["version=4", "version=6"]
    assert paths.child_folders(spark, f"{path}/delta") == ["version=5", "version=6"]
    last = {r.g: (r._t0.s.v, r._t1.s.v if r._t1 else None) for r in state.read(7).collect()}
    assert last == {"a": (5, 4), "b": (-5, -3)}


def test_hot_group_over_micro_batches_equals_the_window(spark, scratch):
    found = [("hot" if i % 3 else f"g{i % 7}", i, i * 11 % 97, i % 5 == 0) for i in range(600)]
    state, out = state_at(spark, scratch(), merge_every=2), []
    for n in range(3):
        out += rows(state.follow(make(spark, found[200 * n : 200 * n + 200][::-1]), n, hot_rows=40).drop("is_late"))
    whole = rows(with_earlier(make(spark, found), "g", ["t"], values()))
    assert sorted(out, key=str) == sorted(whole, key=str)


def test_empty_micro_batches_and_state(spark, scratch):
    state = state_at(spark, scratch())
    assert state.read(0) is None
    state.prime(make(spark, []))
    out = state.follow(make(spark, []), 0)
    assert out.columns == ["g", "t", "v", "bought", "before", "bought_v", "is_late"] and out.isEmpty()
    assert state.read(2).isEmpty()


def test_only_streams_are_followed(spark, scratch):
    with pytest.raises(ValueError):
        stream_batches(make(spark, []), lambda batch, _: batch, scratch(), scratch())
