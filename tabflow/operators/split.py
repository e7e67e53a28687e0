"""Train, validation and test rows: by date, at random, or by file. Every splitter adds a ``split`` column."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import quote, row_digest
from tabflow.functions.dates import parse_datetime
from tabflow.functions.types import is_temporal
from tabflow.sources import paths
from tabflow.sources.schema import date_formats

SEGMENTS = ("train", "valid", "test")


@dataclass
class DateSplitter:
    """The last months are test rows, the months before them validation rows; rows without a date are test rows."""

    date_col: str
    months_test: int = 2
    months_valid: int = 2
    today: dt.datetime | None = None
    bounds: tuple[dt.datetime, dt.datetime] | None = field(default=None, init=False)
    format: str | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        if self.months_test <= 0 or self.months_valid <= 0:
            raise ValueError("months_test and months_valid must be positive")

    def _format_of(self, df: DataFrame) -> str | None:
        """The format of a text date column; None for a column of dates."""
        t = df.schema[self.date_col].dataType
        if is_temporal(t):
            return None
        found = date_formats(df, [self.date_col]) if isinstance(t, T.StringType) else {}
        if not found:
            raise TypeError(f"{self.date_col} is not a date column")
        return found[self.date_col]

    def _dated(self, df: DataFrame, format: str | None) -> DataFrame:
        if format is None:
            return df
        return df.withColumn(self.date_col, parse_datetime(F.col(quote(self.date_col)), format))

    def _find(self, df: DataFrame) -> tuple[tuple[dt.datetime, dt.datetime], str | None]:
        format = self._format_of(df)
        last = F.max(F.col(quote(self.date_col)).cast("date"))
        fallback = F.lit((self.today or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).date())
        test = F.add_months(F.coalesce(last, fallback), -self.months_test)
        row = self._dated(df, format).agg(test.alias("test"), F.add_months(test, -self.months_valid).alias("valid")).first()
        start_of_day = lambda d: dt.datetime(d.year, d.month, d.day)
        return (start_of_day(row.valid), start_of_day(row.test)), format

    def fit(self, df: DataFrame) -> DateSplitter:
        """Finds where validation and test begin; two literals, whatever the size of the table. They hold until the next fit."""
        self.bounds, self.format = self._find(df)
        return self

    def _placed(self, df: DataFrame) -> tuple[DataFrame, Column, Column]:
        """The frame with its dates, and where validation and test begin: as fitted, or for this frame alone without a fit."""
        if self.bounds is None:
            bounds, format = self._find(df)
        else:
            known = self.format if isinstance(df.schema[self.date_col].dataType, T.StringType) else None
            bounds, format = self.bounds, known or self._format_of(df)
        df = self._dated(df, format)
        kind = df.schema[self.date_col].dataType
        valid, test = (F.lit(b).cast("timestamp_ntz").cast(kind) for b in bounds)
        return df, valid, test

    def assign(self, df: DataFrame) -> DataFrame:
        df, valid, test = self._placed(df)
        c = F.col(quote(self.date_col))
        return df.withColumn("split", F.when(c < valid, "train").when(c < test, "valid").otherwise("test"))

    def rows(self, df: DataFrame, name: str) -> DataFrame:
        """One segment by plain comparisons of the date, which reach the scan; a filter on the label does not."""
        if name not in SEGMENTS:
            raise ValueError(f"unknown segment {name!r}")
        df, valid, test = self._placed(df)
        c = F.col(quote(self.date_col))
        wanted = {"train": c < valid, "valid": (c >= valid) & (c < test), "test": (c >= test) | c.isNull()}[name]
        return df.filter(wanted).withColumn("split", F.lit(name))


_HASH_BITS = 62
_STEP_BITS = 16
_FEW_ROWS = 100_000


@dataclass
class RandomSplitter:
    """Stable pseudo-random split by a hash of the row's key.

    Sizes are exact, floor(n * train) and floor(n * valid) rows, wherever rows have different hashes. Without a ``key``,
    rows of a Parquet scan are told apart by path and row number, so copies of one row spread over the segments; other
    frames use all columns, and copies then stay together. ``exact=False`` compares the hash with fixed thresholds,
    which needs no pass over the data and also works on a stream.
    """

    train: float = 0.6
    valid: float = 0.2
    test: float = 0.2
    seed: int = 42
    key: Sequence[str] | None = None
    exact: bool = True
    cuts: tuple[int, int] | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        ratios = (self.train, self.valid, self.test)
        if not all(0 < r < 1 for r in ratios):
            raise ValueError("every ratio must lie between 0 and 1")
        if abs(sum(ratios) - 1) > 1e-10:
            raise ValueError("the ratios must sum to 1")

    def _hash(self, df: DataFrame) -> tuple[DataFrame, Column]:
        seed = F.lit(self.seed)
        if self.key is not None:
            keyed, digest = df, row_digest(self.key, seed)
        else:
            try:
                keyed = df.select("*", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"), seed).alias("_row"))
                digest = F.col("_row")
                keyed.schema  # noqa: B018  resolves the metadata columns
            except AnalysisException:
                keyed, digest = df, row_digest(df.columns, seed)
        return keyed, F.shiftrightunsigned(digest, 64 - _HASH_BITS)

    def _find(self, df: DataFrame) -> tuple[int, int]:
        top = 1 << _HASH_BITS
        if not self.exact:
            return int(top * self.train), int(top * (self.train + self.valid))
        keyed, h = self._hash(df)
        hashes = keyed.select(h.alias("h"))
        shift = _HASH_BITS - _STEP_BITS
        counts = _histogram(hashes, shift)
        n = sum(counts.values())
        n_train = math.floor(n * self.train)
        targets = (n_train, n_train + math.floor(n * self.valid))
        return tuple(_hash_at_rank(hashes, counts, shift, rank) for rank in targets)

    def fit(self, df: DataFrame) -> RandomSplitter:
        """Finds the cuts of this frame. They hold until the next fit."""
        self.cuts = self._find(df)
        return self

    def assign(self, df: DataFrame) -> DataFrame:
        """By the fitted cuts; without a fit by this frame's own, which are not kept."""
        keyed, h = self._hash(df)
        train_end, valid_end = self.cuts or self._find(df)
        label = F.when(h < F.lit(train_end), "train").when(h < F.lit(valid_end), "valid").otherwise("test")
        return keyed.withColumn("split", label).drop("_row")


def _histogram(hashes: DataFrame, shift: int) -> dict[int, int]:
    """Rows per hash prefix; at most 65,536 entries, combined in the map tasks."""
    rows = hashes.groupBy(F.shiftright("h", shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.p: r.n for r in rows}


def _hash_at_rank(hashes: DataFrame, counts: dict[int, int], shift: int, rank: int) -> int:
    """Smallest bound with ``rank`` hashes below it. Narrows to one prefix, then to the next 16 bits of it, and so on."""
    below = 0
    while True:
        found = None
        for prefix in sorted(counts):
            if below + counts[prefix] > rank:
                found = prefix
                break
            below += counts[prefix]
        if found is None:
            return 1 << _HASH_BITS
        if below == rank:
            return found << shift
        if shift == 0:
            return found
        inside = hashes.filter(F.shiftright("h", shift) == found)
        if counts[found] <= _FEW_ROWS:
            values = inside.agg(F.sort_array(F.collect_list("h"))).first()[0]
            return values[rank - below]
        step = min(_STEP_BITS, shift)
        shift -= step
        counts = _histogram(inside, shift)


@dataclass
class PredefinedSplitter:
    """Segments given as lists of file names, without folder and extension."""

    train: Sequence[str] = ()
    valid: Sequence[str] = ()
    test: Sequence[str] = ()

    def __post_init__(self) -> None:
        lists = [list(getattr(self, s)) for s in SEGMENTS]
        if not all(lists):
            raise ValueError("train, valid and test each need at least one file")
        flat = [n for names in lists for n in names]
        if len(flat) != len(set(flat)):
            raise ValueError("a file may belong to one segment only")

    def read(
        self, spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, format: str | None = None, **options
    ) -> DataFrame:
        """One scan over all listed files, so that their types are settled together; the segment comes from the file's name."""
        from tabflow.sources.files import scan

        wanted = [name for s in SEGMENTS for name in getattr(self, s)]
        found = paths.list_files(spark, path).select(_stem(F.col("name")).alias("stem")).filter(F.col("stem").isin(wanted)).distinct().collect()
        missing = set(wanted) - {r.stem for r in found}
        if missing:
            raise FileNotFoundError(f"no file for {sorted(missing)} below {path}")
        listed = lambda name: _stem(name).isin(wanted)
        rows = scan(spark, path, format=format, schema=schema, file_filter=listed, file_column="_file", **options)
        return rows.withColumn("split", self._label(_stem(F.col("_file")))).drop("_file")

    def _label(self, stem: Column) -> Column:
        label = F.lit(None).cast("string")
        for s in SEGMENTS:
            label = F.when(stem.isin(*getattr(self, s)), s).otherwise(label)
        return label

    def assign(self, df: DataFrame) -> DataFrame:
        """For a frame straight from a file scan: the segment of the file a row was read from."""
        return df.select("*", self._label(_stem(F.col("_metadata.file_name"))).alias("split")).filter(F.col("split").isNotNull())


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(csv\.gz|[^.]+)$", "")


def write_split(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table with a folder per segment, so that reading a segment opens no other file."""
    df.write.mode(mode).partitionBy("split").parquet(path)
