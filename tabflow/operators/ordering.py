"""Global order without a single-task sort: range buckets, running totals, ranks and key batches.

A window without a partition key pulls the whole table into one task. Here the order column is cut into ranges of about
``ROWS_PER_RANGE`` rows, however many that are; rows are ranked inside their range, and the range totals (one row per range) give each
range its offset. Numbers and times are cut at approximate quantiles: up to ``LEVEL_RANGES`` of them are literals, so a recomputed task
gets the same ranges; beyond, each of these ranges is cut again at its own quantiles, which are a written table, and offsets are summed
in two levels, too. Other types, text above all, are cut at sampled whole keys.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import quote
from tabflow.functions.dates import epoch_micros
from tabflow.functions.types import is_numeric
from tabflow.session import cut_lineage

ROWS_PER_RANGE = 250_000
LEVEL_RANGES = 1_000
#: Rows that a task ranks, about.
ROWS_PER_TASK = 1_000_000
#: Cuts that are looked at together; a search looks at two such runs.
_RUN = 32
_SPAN = 1 << 20
_LAST = 1 << 60
_EXACT_DOUBLE = float(2**53)


def exact_position(t: T.DataType) -> bool:
    """Whether two different keys always have different positions (for whole numbers: below 2**53)."""
    return isinstance(
        t,
        (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType),
    )


def position(df: DataFrame, key: str) -> Column:
    """A double that never decreases when the key increases. NULL keys come first."""
    t = df.schema[key].dataType
    c = F.col(quote(key))
    if is_numeric(t):
        p = c.cast("double")
    elif isinstance(t, T.BooleanType):
        p = c.cast("int").cast("double")
    elif isinstance(t, T.DateType):
        p = F.unix_date(c).cast("double")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        p = epoch_micros(c, t).cast("double")
    else:
        raise TypeError(f"cannot order by {key} of type {t.simpleString()}")
    return F.coalesce(p, F.lit(float("-inf")))


def _least_ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class RangeCuts:
    """Quantile cuts of one order column, and the values that fill a whole range by themselves.

    ``finer`` holds, for each range of the first level, the cuts inside it: (_coarse, _cuts); None where one level is enough.
    """

    def __init__(self, cuts: list[float], heavy: list[float], finer: DataFrame | None = None, rows: int = 0):
        self.cuts = cuts
        self.heavy = heavy
        self.finer = finer
        self.rows = rows

    @classmethod
    def of(cls, df: DataFrame, pos: Column, ranges: int | None = None) -> RangeCuts:
        level = LEVEL_RANGES
        probs = [i / level for i in range(1, level)]
        found = df.agg(F.percentile_approx(pos, probs, max(10_000, 10 * level)).alias("q"), F.count(F.lit(1)).alias("n")).first()
        quantiles = [q for q in found.q or [] if math.isfinite(q)]
        heavy = sorted({a for a, b in zip(quantiles, quantiles[1:]) if a == b and abs(a) < _EXACT_DOUBLE})
        wanted = ranges or max(2, _least_ranges(df), math.ceil(found.n / ROWS_PER_RANGE))
        step = max(1, len(quantiles) // min(wanted, level))
        cuts = set(quantiles[step - 1 :: step]) | set(heavy)
        cuts.update(math.nextafter(h, math.inf) for h in heavy)
        out = cls(sorted(cuts), heavy, rows=found.n)
        inside = math.ceil(wanted / level)
        if inside > 1 and out.cuts:
            probs = [i / inside for i in range(1, inside)]
            coarse = out._level(df.withColumn("_pos2", pos), F.col("_pos2"), "_coarse")
            finer = coarse.groupBy("_coarse").agg(F.percentile_approx("_pos2", probs, max(1_000, 10 * inside)).alias("q"))
            finite = F.array_distinct(F.filter("q", lambda v: (v > float("-inf")) & (v < float("inf"))))
            out.finer = cut_lineage(finer.select("_coarse", F.sort_array(finite).alias("_cuts")))
        return out

    def _level(self, df: DataFrame, pos: Column, name: str) -> DataFrame:
        """Adds the number of the range of the first level; the search in the sorted cuts is a JVM binary search."""
        from pyspark.ml.feature import Bucketizer

        if not self.cuts:
            return df.withColumn(name, F.lit(0).cast("long"))
        splits = [-math.inf, *self.cuts, math.inf]
        bucketizer = Bucketizer(splits=splits, inputCol=f"{name}_pos", outputCol=name, handleInvalid="keep")
        return bucketizer.transform(df.withColumn(f"{name}_pos", pos)).drop(f"{name}_pos").withColumn(name, F.col(name).cast("long"))

    def assign(self, df: DataFrame, pos: Column, name: str) -> DataFrame:
        """Adds the range number, a multiple of _SPAN for the first level plus the place inside it."""
        if self.finer is None:
            return self._level(df, pos, name).withColumn(name, F.col(name) * _SPAN)
        # Joined by a number of at most some thousand values: all rows of the table together are one double a range.
        at = self._level(df.withColumn("_pos2", pos), F.col("_pos2"), "_coarse").join(self.finer, "_coarse", "left")
        below = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("_pos2")))
        heads = F.filter("_cuts", lambda c, i: i % _RUN == 0)
        run = F.greatest(below(heads) - 1, F.lit(0))
        place = run * _RUN + below(F.slice("_cuts", run * _RUN + 1, F.lit(_RUN)))
        number = F.col("_coarse") * _SPAN + F.when(F.size("_cuts") > 0, place).otherwise(0)
        return at.withColumn(name, number).drop("_coarse", "_cuts", "_pos2")


def assign_ranges(df: DataFrame, key: str, name: str, ranges: int | None = None) -> DataFrame:
    """Adds a range number that never decreases with the key; equal keys share a range.

    Types without an exact position, text above all, are cut by Spark's own range partitioning, which samples whole keys
    and so stays balanced when they share long prefixes or hold strays. The result is written, because another run would sample anew.
    """
    return _ranges_and_rows(df, key, name, ranges)[0]


def _ranges_and_rows(df: DataFrame, key: str, name: str, ranges: int | None) -> tuple[DataFrame, int]:
    if exact_position(df.schema[key].dataType):
        pos = position(df, key)
        cuts = RangeCuts.of(df, pos, ranges)
        return cuts.assign(df, pos, name), cuts.rows
    rows = df.count()
    n = ranges or max(2, _least_ranges(df), math.ceil(rows / ROWS_PER_RANGE))
    placed = df.repartitionByRange(n, F.col(quote(key)).asc_nulls_first())
    return cut_lineage(placed.withColumn(name, F.spark_partition_id().cast("long") * _SPAN)), rows


def _dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Dealt over tasks of about ROWS_PER_TASK rows. Left to itself, Spark joins parts by their packed bytes, some ten times smaller than what a
    task then sorts, or takes the rows as a join by range left them, which puts all rows of a frequent key into one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK)), *by)


def _offsets(per_range: DataFrame, sums: list[str], names: list[str]) -> DataFrame:
    """_range and, for each of ``sums``, the sum over all smaller ranges: inside the first level by window, between its ranges by their totals."""
    level = F.floor(F.col("_range") / _SPAN).alias("_level")
    inside = Window.partitionBy("_level").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    between = Window.orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)  # at most some thousand rows, or one a range of sampled keys
    rows = per_range.withColumn("_level", level)
    total = rows.groupBy("_level").agg(*[F.sum(s).alias(s) for s in sums])
    total = total.select("_level", *[F.coalesce(F.sum(s).over(between), F.lit(0)).alias(f"_t{i}") for i, s in enumerate(sums)])
    before = [(F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_t{i}")).alias(n) for i, (s, n) in enumerate(zip(sums, names, strict=True))]
    return rows.join(total, "_level").select("_range", *before)


def running_total(df: DataFrame, key: str, totals: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """For a frame with unique keys: the sums of ``totals`` over all rows with a smaller key, added as columns."""
    bucketed, n_rows = _ranges_and_rows(df, key, "_range", ranges)
    names = list(totals)
    inner = [totals[n].alias(f"_v{i}") for i, n in enumerate(names)]
    valued = bucketed.select("*", *inner)
    per_range = valued.groupBy("_range").agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))])
    offsets = _offsets(per_range, [f"_s{i}" for i in range(len(names))], [f"_o{i}" for i in range(len(names))])
    inside = Window.partitionBy("_range").orderBy(F.col(quote(key)).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    keep = [F.col(quote(c)) for c in df.columns]
    within = _dealt(valued, n_rows, "_range").select(*keep, "_range", *[F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)).alias(f"_w{i}") for i in range(len(names))])
    out = within.join(F.broadcast(offsets), "_range")
    return out.select(*keep, *[(F.col(f"_o{i}") + F.col(f"_w{i}")).alias(n) for i, n in enumerate(names)])


def global_rank(df: DataFrame, key: str, name: str = "rank", descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Number of rows with a smaller key (a larger one when descending), added as a column. NULL is the smallest key.

    Rows of a key that fills whole ranges, and rows without a key, all have rank 1 inside a range of their own, so each
    is a group by itself and they spread over all tasks. Types without an exact position are ranked on their distinct keys and joined back.
    """
    if not exact_position(df.schema[key].dataType):
        return _rank_by_distinct_key(df, key, name, descending, ranges)
    pos = F.lit(-1.0 if descending else 1.0) * position(df, key)
    cuts = RangeCuts.of(df, pos, ranges)
    no_key = F.col(quote(key)).isNull()
    bucketed = cuts.assign(df.withColumn("_pos", pos), F.col("_pos"), "_range")
    alone = no_key | F.col("_pos").isin(cuts.heavy) if cuts.heavy else no_key
    bucketed = bucketed.withColumns(
        {
            "_range": F.when(no_key, F.lit(_LAST if descending else -_SPAN)).otherwise(F.col("_range")),
            "_spread": F.when(alone, F.monotonically_increasing_id()).otherwise(F.lit(-1)),
        }
    )
    per_range = bucketed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(per_range, ["_n"], ["_before"])
    order = F.col(quote(key)).desc_nulls_last() if descending else F.col(quote(key)).asc_nulls_first()
    inside = F.rank().over(Window.partitionBy("_range", "_spread").orderBy(order))
    keep = [F.col(quote(c)) for c in df.columns]
    within = _dealt(bucketed, cuts.rows, "_range", "_spread").select(*keep, "_range", inside.alias("_within"))
    out = within.join(F.broadcast(offsets), "_range")
    return out.select(*keep, (F.col("_before") + F.col("_within") - 1).cast("long").alias(name))


def _rank_by_distinct_key(df: DataFrame, key: str, name: str, descending: bool, ranges: int | None) -> DataFrame:
    counts = cut_lineage(df.groupBy(F.col(quote(key)).alias("_key")).agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_total(counts, "_key", {"_before": F.col("_n")}, ranges)
    if descending:
        total = counts.agg(F.sum("_n")).first()[0] or 0
        ranked = ranked.withColumn("_before", F.lit(total) - F.col("_before") - F.col("_n"))
    out = df.join(ranked, F.col(quote(key)).eqNullSafe(F.col("_key")), "left")
    return out.select(*[F.col(quote(c)) for c in df.columns], F.col("_before").cast("long").alias(name))


def key_batches(
    df: DataFrame,
    key: str,
    size: int,
    start=None,
    descending: bool = False,
    filter: Column | str | None = None,
    name: str = "batch",
    ranges: int | None = None,
) -> DataFrame:
    """Adds a batch number: ``size`` rows per batch in key order, from ``start``; equal keys stay in one batch.

    The user's filter and the start apply together. Every remaining row is in exactly one batch.
    """
    if size < 1:
        raise ValueError("batch size must be positive")
    if filter is not None:
        df = df.filter(filter)
    if start is not None:
        df = df.filter(F.col(quote(key)) <= start if descending else F.col(quote(key)) >= start)
    ranked = global_rank(df, key, "_rank", descending, ranges)
    return ranked.withColumn(name, F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def batch_bounds(batched: DataFrame, key: str, name: str = "batch") -> DataFrame:
    """First key, last key and row count of every batch."""
    return batched.groupBy(name).agg(
        F.min(quote(key)).alias("batch_start"), F.max(quote(key)).alias("batch_end"), F.count(F.lit(1)).alias("num_rows")
    )


# ---------------------------------------------------------------- fixed key ranges


def key_partition(key: Column, size: int) -> Column:
    """Partition number of an integer-like key: 1 for keys 0..size-1, 2 for the next ``size`` keys, and so on."""
    return (F.floor(key.cast("decimal(38,6)") / F.lit(size)) + 1).cast("long")


def partition_bounds(df: DataFrame, key: str, size: int) -> DataFrame:
    """Non-empty key partitions in ascending order with their bounds; the last one ends at the largest key."""
    c = F.col(quote(key))
    per = df.filter(c.isNotNull()).groupBy(key_partition(c, size).alias("partition")).agg(F.count(F.lit(1)).alias("num_rows"), F.max(c).alias("_max"))
    top = per.agg(F.max("partition")).first()[0]
    start = (F.col("partition") - 1) * size
    end = F.col("partition") * size - 1
    return per.select(
        "partition",
        start.cast("long").alias("partition_start"),
        F.when(F.col("partition") == F.lit(top), F.col("_max").cast("long")).otherwise(end).cast("long").alias("partition_end"),
        "num_rows",
    ).orderBy("partition")
