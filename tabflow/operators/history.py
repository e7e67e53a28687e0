"""Earlier rows of the same group: previous value, last value that meets a condition.

A window sorts each group in one task. Groups beyond ``hot_rows`` rows are therefore cut into ranges of the order, at most so many rows
each; each (group, range) is its own window partition, and the state that a range hands to the next one, one row per range, is
joined back. Without such groups the plan is the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions.columns import quote
from tabflow.session import cut_lineage

HOT_ROWS = 5_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of hot groups that a task sorts, about.
ROWS_PER_TASK = 1_000_000
_TASK = 1 << 33


@dataclass(frozen=True)
class Earlier:
    """A value taken from earlier rows: from the row just before, or from the last one where ``where`` holds."""

    value: Column
    where: Column | None = None


def hot_groups(df: DataFrame, group: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(_hot_group, _hot_rows): all groups beyond the limit, however many; a written table."""
    counts = df.groupBy(F.col(quote(group)).alias("_hot_group")).agg(F.count(F.lit(1)).alias("_hot_rows"))
    return cut_lineage(counts.filter(F.col("_hot_rows") > hot_rows))


def with_earlier(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    values: Mapping[str, Earlier],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds one column per entry of ``values``. ``order`` must order the rows of a group fully, e.g. time and id."""
    hot = hot_groups(df, group, hot_rows)
    by = [F.col(quote(c)).asc_nulls_first() for c in order]
    names = list(values)
    # Wrapped in a struct, so that an earlier NULL value differs from no earlier row.
    marked = df.withColumns(
        {
            f"_e{i}": F.when(F.lit(True) if values[n].where is None else values[n].where, F.struct(values[n].value.alias("v")))
            for i, n in enumerate(names)
        }
    )
    keep = [F.col(quote(c)) for c in df.columns]
    if hot.isEmpty():
        before = Window.partitionBy(quote(group)).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        taken = [F.last(F.col(f"_e{i}"), ignorenulls=True).over(before).getField("v").alias(n) for i, n in enumerate(names)]
        return marked.select(*keep, *taken)

    known = hot.select("_hot_group", F.lit(True).alias("_is_hot"))
    if _measured_small(hot):
        known = F.broadcast(known)
    marked = marked.join(known, F.col(quote(group)).eqNullSafe(F.col("_hot_group")), "left").drop("_hot_group")
    is_hot = F.coalesce(F.col("_is_hot"), F.lit(False))
    ranged = cut_hot_groups(marked, is_hot, group, order, hot, hot_rows)
    ordering = F.struct(*[F.col(quote(c)) for c in order])
    handed = (
        ranged.filter(is_hot)
        .groupBy(F.col(quote(group)).alias("_group"), F.col("_range").alias("_of"))
        .agg(*[F.max_by(F.col(f"_e{i}"), F.when(F.col(f"_e{i}").isNotNull(), ordering)).alias(f"_h{i}") for i in range(len(names))])
    )
    # One row per hot group and range: the length of a chain is the number of ranges.
    handed = cut_lineage(handed)
    chain = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    carried = handed.select("_group", "_of", *[F.last(f"_h{i}", ignorenulls=True).over(chain).alias(f"_c{i}") for i in range(len(names))])
    if _measured_small(handed):
        carried = F.broadcast(carried)
    inside = Window.partitionBy(quote(group), "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.select(
        *keep, "_range", *[F.last(F.col(f"_e{i}"), ignorenulls=True).over(inside).alias(f"_w{i}") for i in range(len(names))]
    )
    out = within.join(carried, F.col(quote(group)).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")), "left")
    return out.select(*keep, *[F.coalesce(F.col(f"_w{i}"), F.col(f"_c{i}")).getField("v").alias(n) for i, n in enumerate(names)])


def _measured_small(df: DataFrame) -> bool:
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("chars")).first()
    return (size.chars or 0) + 64 * size.n <= BROADCAST_BYTES


def cut_hot_groups(df: DataFrame, is_hot: Column, group: str, order: Sequence[str], hot: DataFrame, hot_rows: int) -> DataFrame:
    """Adds ``_range``: a number that never decreases in the order of a hot group and that at most ``hot_rows`` of its rows share.

    Rows are ordered by group first, so a range holds rows of few groups: cuts of the order alone would cut each group at the rows of all
    others, which gives groups times ranges pieces. How many tasks sort does not depend on how small the ranges are.
    """
    rows, hot_rows = hot.agg(F.sum("_hot_rows")).first()[0], max(1, hot_rows)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_TASK))
    return _cut_groups(df, is_hot, [group, *order], max(2, min(math.ceil(2 * rows / hot_rows), tasks)), hot_rows)


def _cut_groups(df: DataFrame, is_hot: Column, order: Sequence[str], ranges: int, rows_each: int | None = None) -> DataFrame:
    """Adds ``_range``: a number that never decreases in the given order, and the same one for all rows of other groups.

    Spark's range partitioning samples the whole order, so a frequent value of the first column is cut by the next one, and text by
    all of it. With ``rows_each`` each of these ranges is cut again after so many rows. The cut rows are written, because another run
    would sample anew.
    """
    by = [F.col(quote(c)).asc_nulls_first() for c in order]
    placed, number = df.filter(is_hot).repartitionByRange(ranges, *by), F.spark_partition_id().cast("long")
    if rows_each is not None:
        placed = placed.sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id() % _TASK)
        number = number * _TASK + F.floor(F.col("_place") / rows_each)
    placed = cut_lineage(placed.withColumn("_range", number).drop("_place"))
    return placed.unionByName(df.filter(~is_hot).withColumn("_range", F.lit(-1).cast("long")))


def previous_value(df: DataFrame, group: str, order: Sequence[str], value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The value of the row just before in the same group."""
    return with_earlier(df, group, order, {name: Earlier(F.col(quote(value)))}, hot_rows)


def last_where(
    df: DataFrame, group: str, order: Sequence[str], value: str, where: Column, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The value of the last earlier row of the same group for which the condition holds."""
    return with_earlier(df, group, order, {name: Earlier(F.col(quote(value)), where)}, hot_rows)
