"""Column statistics. Values that imputation uses are learned from training rows only; counts use all rows.

All statistics with a fixed-size state are one aggregation over one scan. Distinct counts and modes come from one shared
value table (one shuffle, combined in the map tasks). Medians are exact without holding a column's values anywhere: the
range that holds the middle rank is narrowed with quantile sketches of samples, every step is checked by counting all
rows, and only the last small range is read. So no step needs memory that grows with the table.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import clip as clip_column
from tabflow.functions.columns import quote
from tabflow.functions.dates import epoch_micros
from tabflow.functions.types import is_integer, is_numeric
from tabflow.session import cut_lineage

ONE_PASS = ("num_rows", "null_count", "mean", "min", "max", "std", "last_value")
FROM_VALUES = ("unique_count", "most_frequent_value")
ALL_STATS = (*ONE_PASS, "median", *FROM_VALUES)

_MEDIAN_AT_ONCE = 1_000_000
_LAST_RANGE = 100_000
_SKETCH = 10_000
_SAMPLE = 2_000_000
_LONG_TEXT = 64


@dataclass
class Statistics:
    """Fitted values by column and statistic. Its size depends on the number of columns, not of rows."""

    columns: dict[str, dict[str, Any]] = field(default_factory=dict)

    def get(self, column: str, stat: str) -> Any:
        return self.columns.get(column, {}).get(stat)

    def update(self, other: Statistics) -> Statistics:
        for c, values in other.columns.items():
            self.columns.setdefault(c, {}).update(values)
        return self

    def to_json(self) -> str:
        return json.dumps(self.columns, default=_encode)

    @classmethod
    def from_json(cls, text: str) -> Statistics:
        return cls(json.loads(text, object_hook=_decode))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The profile table: column, statistic, value as text."""
        rows = [(c, s, _as_text(v)) for c, values in self.columns.items() for s, v in values.items() if not isinstance(v, (list, dict))]
        return spark.createDataFrame(rows, "column string, stat string, value string")


def _as_text(v: Any) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def _encode(v: Any) -> Any:
    if isinstance(v, dt.datetime):
        return {"$datetime": v.isoformat()}
    if isinstance(v, dt.date):
        return {"$date": v.isoformat()}
    if hasattr(v, "__float__"):
        return float(v)
    raise TypeError(f"cannot store {type(v)}")


def _decode(d: dict) -> Any:
    if set(d) == {"$datetime"}:
        return dt.datetime.fromisoformat(d["$datetime"])
    if set(d) == {"$date"}:
        return dt.date.fromisoformat(d["$date"])
    return d


def fit_statistics(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    train: Column | None = None,
    stats: Sequence[str] = ALL_STATS,
    date_column: str | None = None,
    tiebreak: str | None = None,
    clips: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> Statistics:
    """Statistics of the columns. ``train`` marks the training rows; without it every row counts as one."""
    names = [c for c in (columns or df.columns) if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    schema = df.schema
    wanted = set(stats)
    in_train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    extra = [c for c in (date_column, tiebreak) if c and c not in names]
    picked = df.select(
        *[_clipped(c, schema[c].dataType, clips).alias(c) for c in names],
        *[F.col(quote(c)) for c in extra],
        in_train.alias("_train"),
    )
    out: dict[str, dict[str, Any]] = {c: {} for c in names}

    aggregates: list[Column] = []
    slots: list[tuple[str, str]] = []

    def add(c: str, stat: str, expr: Column) -> None:
        if stat in wanted:
            slots.append((c, stat))
            aggregates.append(expr.alias(f"a{len(aggregates)}"))

    for c in names:
        v = F.col(quote(c))
        train_value = F.when(F.col("_train"), v)
        add(c, "num_rows", F.count(F.lit(1)))
        add(c, "null_count", F.count_if(v.isNull()))
        if is_numeric(schema[c].dataType):
            add(c, "mean", F.avg(train_value.cast("double")))
            add(c, "min", F.min(train_value))
            add(c, "max", F.max(train_value))
            add(c, "std", F.stddev_samp(train_value.cast("double")))
        if date_column:
            order = F.struct(F.col(quote(date_column)), *([F.col(quote(tiebreak))] if tiebreak else []), v)
            add(c, "last_value", F.max_by(v, F.when(F.col("_train") & v.isNotNull(), order)))
    numeric = [c for c in names if is_numeric(schema[c].dataType)]
    if "median" in wanted:
        counts_at = {c: len(aggregates) + i for i, c in enumerate(numeric)}
        aggregates += [F.count(F.when(F.col("_train"), F.col(quote(c)))).alias(f"a{counts_at[c]}") for c in numeric]
    if aggregates:
        row = picked.agg(*aggregates).first()
        for i, (c, stat) in enumerate(slots):
            out[c][stat] = row[f"a{i}"]
    if "median" in wanted and numeric:
        train_rows = picked.filter("_train") if train is not None else picked
        counts = {c: row[f"a{counts_at[c]}"] for c in numeric}
        for c, value in exact_medians(train_rows, numeric, counts).items():
            out[c]["median"] = value
    if wanted & set(FROM_VALUES):
        for c, values in _value_statistics(picked, names, schema, train is not None, "most_frequent_value" in wanted).items():
            out[c].update({s: v for s, v in values.items() if s in wanted})
    return Statistics(out)


def _clipped(name: str, t: T.DataType, clips: Mapping[str, tuple] | None) -> Column:
    c = F.col(quote(name))
    if clips and name in clips and is_numeric(t):
        return clip_column(c, *clips[name]).cast(t)
    return c


# ---------------------------------------------------------------- medians


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    counts: Mapping[str, int] | None = None,
    at_once: int = _MEDIAN_AT_ONCE,
    last_range: int = _LAST_RANGE,
    sketch: int = _SKETCH,
) -> dict[str, float | None]:
    """Median (midpoint of the two middle values) of each column. All columns share every pass."""
    if counts is None:
        found = df.agg(*[F.count(quote(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        counts = {c: found[f"n{i}"] for i, c in enumerate(columns)}
    out: dict[str, float | None] = {c: None for c in columns if counts[c] == 0}
    small = [c for c in columns if 0 < counts[c] <= at_once]
    if small:
        row = df.agg(*[F.median(quote(c)).alias(f"m{i}") for i, c in enumerate(small)]).first()
        out.update({c: float(row[f"m{i}"]) for i, c in enumerate(small)})
    ranks = {
        (c, r): _RankRange(c, r, counts[c], sketch, df.schema[c].dataType)
        for c in columns
        if counts[c] > at_once
        for r in {(counts[c] - 1) // 2, counts[c] // 2}
    }
    while open_ranks := [r for r in ranks.values() if r.value is None]:
        last = [r for r in open_ranks if r.inside <= last_range]
        if last:
            row = df.agg(*[r.read().alias(f"v{i}") for i, r in enumerate(last)]).first()
            for i, r in enumerate(last):
                r.value = row[f"v{i}"]
            continue
        sampled = df.withColumn("_u", F.rand(len(open_ranks)))
        guesses = sampled.agg(*[r.guess(F.col("_u")).alias(f"g{i}") for i, r in enumerate(open_ranks)]).first()
        checks = df.agg(*[r.check(guesses[f"g{i}"]).alias(f"c{i}") for i, r in enumerate(open_ranks)]).first()
        for i, r in enumerate(open_ranks):
            r.narrow(guesses[f"g{i}"], checks[f"c{i}"])
    for c in columns:
        found = [float(r.value) for (name, _), r in ranks.items() if name == c]
        if found:
            out[c] = sum(found) / len(found)
    return out


class _RankRange:
    """The open interval of values known to hold one rank of a column, until the value itself is known."""

    def __init__(self, column: str, rank: int, n: int, sketch: int, t: T.DataType):
        self.column, self.rank = F.col(quote(column)), rank
        self.low = self.high = self.value = None
        self.below, self.inside = 0, n
        self.sketch, self.type, self.halve = sketch, t, False

    def _midpoint(self) -> int | decimal.Decimal:
        """The middle of the interval, in whole steps of the type."""
        if isinstance(self.type, T.DecimalType):
            with decimal.localcontext(prec=80):
                step = decimal.Decimal(1).scaleb(-self.type.scale)
                low, high = (e if v is None else int(v / step) for e, v in ((-(10**self.type.precision), self.low), (10**self.type.precision, self.high)))
                return (low + high) // 2 * step
        low, high = -(2**63) - 1 if self.low is None else self.low, 2**63 if self.high is None else self.high
        return (low + high) // 2

    def _within(self) -> Column:
        held = self.column.isNotNull()
        if self.low is not None:
            held = held & (self.column > F.lit(self.low))
        if self.high is not None:
            held = held & (self.column < F.lit(self.high))
        return held

    def guess(self, u: Column) -> Column:
        """Two values of the interval that probably enclose the rank, by a sketch of a sample of the interval."""
        if self.halve:
            return F.array(F.lit(self._midpoint()), F.lit(self._midpoint()))
        sample = min(self.inside, _SAMPLE)
        share, slack = (self.rank - self.below) / self.inside, 2.0 / self.sketch
        picked = self._within()
        if sample < self.inside:
            slack += 2.0 / math.sqrt(sample)
            picked = picked & (u < sample / self.inside)
        ends = [max(0.0, share - slack), min(1.0, share + slack)]
        return F.percentile_approx(F.when(picked, self.column), ends, self.sketch)

    def check(self, ends: Sequence[Any]) -> Column:
        """Exact row counts below and at both values; the next interval rests on these, not on the sketch."""
        a, b = F.lit(ends[0]), F.lit(ends[1])
        c = self.column
        return F.struct(
            F.count_if(c < a).alias("under_a"), F.count_if(c <= a).alias("upto_a"), F.count_if(c < b).alias("under_b"), F.count_if(c <= b).alias("upto_b")
        )

    def narrow(self, ends: Sequence[Any], n: Any) -> None:
        before = self.inside
        if self.rank < n.under_a:
            self._set(self.low, ends[0], self.below, n.under_a)
        elif self.rank < n.upto_a:
            self.value = ends[0]
        elif self.rank < n.under_b:
            self._set(ends[0], ends[1], n.upto_a, n.under_b)
        elif self.rank < n.upto_b:
            self.value = ends[1]
        else:
            self._set(ends[1], self.high, n.upto_b, self.below + self.inside)
        if self.value is None and self.inside >= before:
            # A sketch holds doubles, which cannot tell whole numbers beyond 2**53 apart: from here on the interval is halved.
            if not (is_integer(self.type) or isinstance(self.type, T.DecimalType)):
                raise ArithmeticError(f"a quantile sketch does not narrow {self.type.simpleString()}")
            self.halve = True

    def _set(self, low: Any, high: Any, below: int, until: int) -> None:
        self.low, self.high, self.below, self.inside = low, high, below, until - below

    def read(self) -> Column:
        return F.get(F.sort_array(F.collect_list(F.when(self._within(), self.column))), F.lit(self.rank - self.below))


# ---------------------------------------------------------------- value table


def _slot(c: Column, t: T.DataType) -> dict[str, Column]:
    """A value in one of three typed places, so that columns of all types share one table."""
    s, l, d = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("double")
    long_text = F.lit(False)
    if isinstance(t, T.StringType):
        long_text = F.coalesce(F.length(c) > _LONG_TEXT, F.lit(False))
        s = F.when(long_text, F.sha2(c, 256)).otherwise(c)
    elif is_integer(t) or isinstance(t, T.BooleanType):
        l = c.cast("long")
    elif isinstance(t, T.DateType):
        l = F.unix_date(c).cast("long")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        l = epoch_micros(c, t)
    elif is_numeric(t):
        d = c.cast("double")
    else:
        s = c.cast("string")
    return {"s": s, "l": l, "d": d, "digest": long_text}


def value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, n_train) for every distinct value of every column, NULL included, in one shuffle.

    The frame needs a boolean column ``_train``. Text beyond 64 characters is represented by its SHA-256.
    """
    entries = []
    for c in columns:
        slot = _slot(F.col(quote(c)), df.schema[c].dataType)
        entries.append(F.struct(F.lit(c).alias("column"), *[e.alias(k) for k, e in slot.items()]))
    pairs = df.select("_train", F.inline(F.array(*entries)))
    return pairs.groupBy("column", "s", "l", "d", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_train")).alias("n_train")
    )


def _value_statistics(df: DataFrame, columns: Sequence[str], schema: T.StructType, split: bool, modes: bool) -> dict[str, dict[str, Any]]:
    counted = "n_train" if split else "n"
    present = F.coalesce(F.col("s").isNotNull() | F.col("l").isNotNull() | F.col("d").isNotNull(), F.lit(False)) & (F.col(counted) > 0)
    short = present & ~F.col("digest")
    value = F.struct("s", "l", "d", counted)
    rows = (
        value_table(df, columns)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.min_by(value, F.when(short, F.struct((-F.col(counted)).alias("k"), F.col("s"), F.col("l"), F.col("d")))).alias("mode"),
            F.max(F.when(present & F.col("digest"), F.col(counted))).alias("most_of_long"),
        )
        .collect()
    )
    out: dict[str, dict[str, Any]] = {}
    for r in rows:
        t = schema[r.column].dataType
        mode = _typed(r.mode, t)
        if modes and r.most_of_long and (r.mode is None or r.most_of_long >= r.mode[counted]):
            long_text = _least_long_text(df, r.column, counted, r.most_of_long)
            tied = r.mode is not None and r.most_of_long == r.mode[counted]
            mode = min(mode, long_text, key=lambda v: v.encode()) if tied else long_text
        values: dict[str, Any] = {"most_frequent_value": mode}
        if not is_numeric(t):
            values["unique_count"] = r.unique_count
        out[r.column] = values
    return out


def _least_long_text(df: DataFrame, column: str, counted: str, n: int) -> str:
    """Of the long texts that occur ``n`` times the first in order. Only digests are grouped; the texts are compared where they are."""
    c = F.col(quote(column))
    tied = value_table(df, [column]).filter(F.col("digest") & (F.col(counted) == n)).select("s")
    texts = df.filter(F.length(c) > _LONG_TEXT).select(c.alias("text"), F.sha2(c, 256).alias("s"))
    return texts.join(tied, "s", "left_semi").agg(F.min("text")).first()[0]


def _typed(v: Any, t: T.DataType) -> Any:
    if v is None:
        return None
    if v.s is not None:
        return v.s
    if v.d is not None:
        return v.d
    if isinstance(t, T.BooleanType):
        return bool(v.l)
    if isinstance(t, T.DateType):
        return dt.date(1970, 1, 1) + dt.timedelta(days=v.l)
    if isinstance(t, T.TimestampNTZType):
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=v.l)
    if isinstance(t, T.TimestampType):
        return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=v.l)
    return v.l


# ---------------------------------------------------------------- categories


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """value, count of the non-null values."""
    c = F.col(quote(column))
    return df.filter(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def allowed_categories(df: DataFrame, column: str, minimum: int = 1) -> DataFrame:
    """value, count of the values seen at least ``minimum`` times."""
    return category_counts(df, column).filter(F.col("count") >= minimum)


def label_table(allowed: DataFrame) -> DataFrame:
    """value, label: the allowed values in ascending order, numbered from 0. Any number of values."""
    from tabflow.operators.ordering import running_total

    values = cut_lineage(allowed.select("value"))
    return running_total(values, "value", {"label": F.lit(1).cast("long")}).select("value", F.col("label").cast("long").alias("label"))


@dataclass
class Categories:
    """The allowed values of one column: in memory up to ``MAX_INLINE`` values, as a table beyond."""

    values: list | None = None
    table: DataFrame | None = None
    path: str | None = None
    mode: Any = None

    MAX_INLINE = 1000

    @property
    def inline(self) -> bool:
        return self.values is not None

    def labels(self) -> dict[Any, int]:
        return {v: i for i, v in enumerate(self.values)}


def fit_categories(df: DataFrame, minimums: Mapping[str, int], train: Column | None = None, keep_at: str | None = None) -> dict[str, Categories]:
    """Allowed categories and the most frequent value of several columns.

    One scan and shuffle for all columns; what it gives, a row per distinct value, is kept while it is read.
    """
    if not minimums:
        return {}
    rows = df if train is None else df.filter(train)
    names = list(minimums)
    entries = [F.struct(F.lit(c).alias("column"), F.col(quote(c)).cast("string").alias("value")) for c in names]
    pairs = rows.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")).persist()
    try:
        return _categories_of(counts, df, minimums, keep_at)
    finally:
        counts.unpersist()


def _categories_of(counts: DataFrame, df: DataFrame, minimums: Mapping[str, int], keep_at: str | None) -> dict[str, Categories]:
    names, least = list(minimums), F.lit(1)
    for c in names:
        least = F.when(F.col("column") == c, F.lit(minimums[c])).otherwise(least)
    allowed = counts.filter(F.col("count") >= least)
    summary = counts.groupBy("column").agg(
        F.count_if(F.col("count") >= least).alias("allowed"), F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode")
    )
    found = {r["column"]: r for r in summary.collect()}
    out: dict[str, Categories] = {}
    small = [c for c in names if c not in found or found[c].allowed <= Categories.MAX_INLINE]
    values: dict[str, list] = {c: [] for c in small}
    if small:
        for r in allowed.filter(F.col("column").isin(*small)).select("column", "value").collect():
            values[r["column"]].append(r["value"])
    for i, c in enumerate(names):
        t = df.schema[c].dataType
        mode = _parsed(found[c].mode, t) if c in found else None
        if c in values:
            out[c] = Categories(_sorted_as(values[c], t), mode=mode)
            continue
        table, path = label_table(allowed.filter(F.col("column") == c)), None
        if keep_at is None:
            table = cut_lineage(table)
        else:
            path = f"{keep_at}/categories/{i:04d}"
            table.write.mode("overwrite").parquet(path)
            table = df.sparkSession.read.parquet(path)
        out[c] = Categories(table=table, path=path, mode=mode)
    return out


def _parsed(text: str, t: T.DataType) -> Any:
    return text == "true" if isinstance(t, T.BooleanType) else text


def _sorted_as(values: list[str], t: T.DataType) -> list:
    if isinstance(t, T.BooleanType):
        return sorted(_parsed(v, t) for v in values)
    # Spark orders text by its UTF-8 bytes, and so do the label tables.
    return sorted(values, key=lambda v: v.encode())
