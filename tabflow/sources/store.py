"""Parquet stores: append, named, key-partitioned and append-only writes, compaction, snapshots, CSV append.

A store is a folder of generations. Appends go to the newest generation; compaction writes the next one, and readers take
it up when Spark's success marker is there, so a failed job leaves the old generation in use. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import quote, row_digest
from tabflow.functions.types import is_integer
from tabflow.operators.ordering import key_partition
from tabflow.operators.query import query
from tabflow.session import scratch_path
from tabflow.sources import paths

BROADCAST_BYTES = 64 * 1024 * 1024
#: Partition numbers share this many folders, by their remainder, whatever keys a batch holds.
FOLDERS = 1000
ROWS_PER_FILE = 5_000_000


@dataclass
class WriteResult:
    """How a write was done; ``reason`` says why a partitioned store wrote without partitions."""

    mode: str
    reason: str | None = None


class Store:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: str | None = None,
        partition_size: int | None = None,
    ):
        if partition_size is not None and partition_size < 1:
            raise ValueError("partition_size must be positive")
        self.spark, self.path, self.key, self.partition_size = spark, path.rstrip("/"), key, partition_size

    # ------------------------------------------------------------ generations

    def _generations(self) -> list[int]:
        names = [n for n in paths.child_folders(self.spark, self.path) if n.startswith("generation=")]
        done = [n for n in names if paths.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return sorted(int(n.split("=")[1]) for n in done)

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation={generation:06d}"

    def _current(self) -> str:
        found = self._generations()
        return self._folder(found[-1] if found else 1)

    def is_empty(self) -> bool:
        return not self._generations()

    # ------------------------------------------------------------ reads

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        if self.is_empty():
            if schema is None:
                raise FileNotFoundError(f"the store {self.path} holds nothing yet")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self._current()).drop("folder")

    def between(self, low: int, high: int) -> DataFrame:
        """Rows with the key in [low, high]. Only the folders of that range are opened, and those rows' files that were
        written without a partition number; in all of them Parquet's minimum and maximum skip the rest."""
        df = self.spark.read.parquet(self._current())
        if self.partition_size and "folder" in df.columns:
            first, last = low // self.partition_size + 1, high // self.partition_size + 1
            if last - first + 1 < FOLDERS:
                folders = sorted({n % FOLDERS for n in range(first, last + 1)})
                df = df.filter(F.col("folder").isNull() | F.col("folder").isin(folders))
            df = df.filter(F.col("partition").isNull() | F.col("partition").between(first, last))
        return df.filter(F.col(quote(self.key)).between(low, high)).drop("partition", "folder")

    def query(self, filter: Column | str | None = None, keys: tuple[int, int] | None = None, **verbs) -> DataFrame:
        """The query verbs over the stored rows; with a key range ``keys``, only its folders are opened."""
        rows = self.read().drop("partition") if keys is None else self.between(*keys)
        return query(rows, filter=filter, **verbs)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Stored rows whose key is among those of ``keys``, as a semi-join."""
        return self.read().drop("partition").join(keys.select(quote(self.key)), self.key, "left_semi")

    # ------------------------------------------------------------ writes

    def append(self, df: DataFrame) -> WriteResult:
        """Adds the rows; an empty frame writes nothing.

        Columns that are stored but missing in the frame become NULL; columns that are not stored, or of another type, are refused.
        A partitioned store first writes the batch aside, once, because checks and range sampling read it, too.
        """
        df = self._fitting(df)
        if self.partition_size is None:
            if df.isEmpty():
                return WriteResult("skipped", "empty frame")
            df.write.mode("append").parquet(self._current())
            return WriteResult("append")
        aside = scratch_path(self.spark, "batch")
        rows = self._aside(df, aside)
        try:
            return WriteResult("skipped", "empty frame") if rows.isEmpty() else self._write(rows)
        finally:
            paths.delete(self.spark, aside)

    def _fitting(self, df: DataFrame) -> DataFrame:
        if self.is_empty():
            return df
        stored = {f.name: f.dataType for f in self.read().drop("partition").schema.fields}
        odd = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if stored.get(f.name) != f.dataType]
        if odd:
            raise ValueError(f"the store {self.path} has no column {', '.join(odd)}")
        return df.select([F.col(quote(c)) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in stored.items()]) if set(stored) - set(df.columns) else df

    def _write(self, df: DataFrame) -> WriteResult:
        """Writes a batch that can be read several times. An empty batch only leaves its schema, in an empty store."""
        if not self.is_empty() and df.isEmpty():
            return WriteResult("skipped", "empty frame")
        if self.partition_size is None:
            df.write.mode("append").parquet(self._current())
            return WriteResult("append")
        reason = self._unpartitionable(df)
        # Same layout without a number, so that readers see these rows next to partitioned ones.
        number = F.lit(None).cast("long") if reason else key_partition(F.col(quote(self.key)), self.partition_size)
        rows = df.withColumn("partition", number).withColumn("folder", F.pmod("partition", F.lit(FOLDERS)).cast("int"))
        self._sorted(rows).write.mode("append").partitionBy("folder").parquet(self._current())
        return WriteResult("partitioned" if reason is None else "append", reason)

    def _sorted(self, rows: DataFrame, files: int | None = None) -> DataFrame:
        """Few files per folder, each a range of the key. A hash of the row comes last, so rows without a key, or with one key, are cut too."""
        order = [F.col(c) for c in ("folder", "partition") if c in rows.columns]
        order += [F.col(quote(self.key))] if self.key in rows.columns else []
        cut = [*order, row_digest(rows.columns)]
        ranged = rows.repartitionByRange(*cut) if files is None else rows.repartitionByRange(files, *cut)
        return ranged.sortWithinPartitions(*order) if order else ranged

    def _unpartitionable(self, df: DataFrame) -> str | None:
        """Why rows cannot be put into folders by key. Rows without a key are no reason: they get the NULL folder."""
        if self.key is None:
            return "no key is configured"
        if self.key not in df.columns:
            return f"the key {self.key} is not in the frame"
        t = df.schema[self.key].dataType
        if isinstance(t, (T.ArrayType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return f"the key {self.key} is no whole number"
        if is_integer(t):
            return None
        c = F.col(quote(self.key))
        number = c.try_cast("decimal(38,6)")
        odd = c.isNotNull() & (number.isNull() | (number != F.floor(number)))
        return f"the key {self.key} is no whole number" if df.agg(F.count_if(odd)).first()[0] else None

    def append_new(self, df: DataFrame, order_by: list[str] | None = None) -> WriteResult:
        """Adds only rows whose key is not stored yet; of several rows with one key the first by ``order_by``.

        Repeating a write adds nothing and writes no file, so a retried job is harmless. NULL counts as one key.
        """
        if self.key is None:
            raise ValueError("an append-only store needs a key")
        asides = [scratch_path(self.spark, "batch") for _ in range(2)]
        fresh = first_per_key(df, self.key, order_by)
        if not self.is_empty():
            # Columns that only order the rows need not be stored.
            fresh = fresh.drop(*set(order_by or ()).difference(self.read().columns))
        fresh = self._aside(self._fitting(fresh), asides[0])
        try:
            if not self.is_empty():
                fresh = self._aside(without_known(fresh, self.read(), self.key), asides[1])
            return self._write(fresh)
        finally:
            for aside in asides:
                paths.delete(self.spark, aside)

    def _aside(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append_named(self, df: DataFrame, name: str) -> WriteResult:
        """Adds the rows below a sub-folder of their own."""
        return Store(self.spark, f"{self.path}/{name}", self.key, self.partition_size).append(df)

    def compact(self, rows_per_file: int = ROWS_PER_FILE, keep_old: bool = False) -> None:
        """Rewrites the store sorted by key into files of about ``rows_per_file`` rows, as a new generation."""
        found = self._generations()
        if not found:
            return
        df = self.spark.read.parquet(self._current())
        files = max(1, math.ceil(df.count() / rows_per_file))
        target = self._folder(found[-1] + 1)
        writer = self._sorted(df, files).write.mode("overwrite")
        (writer.partitionBy("folder") if "folder" in df.columns else writer).parquet(target)
        if not keep_old:
            for g in found:
                paths.delete(self.spark, self._folder(g))


def first_per_key(df: DataFrame, key: str, order_by: list[str] | None = None) -> DataFrame:
    """One row per key; both forms combine in the map tasks, so copies of one key cost one row of the shuffle each."""
    if not order_by:
        return df.dropDuplicates([key])
    rest = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(quote(c)) for c in order_by], *[F.col(quote(c)) for c in rest])
    picked = df.groupBy(F.col(quote(key))).agg(F.min_by(F.struct(*[F.col(quote(c)) for c in rest]), order).alias("_row"))
    return picked.select([F.col(quote(c)) if c == key else F.col("_row").getField(c).alias(c) for c in df.columns])


def without_known(fresh: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``fresh`` whose key is not stored.

    A small batch against a large store should not shuffle the store. If the keys of the batch are measured to be small,
    they are sent to the store's tasks, and only the keys found there come back; otherwise both sides are shuffled.
    """
    a, b = F.col(quote(key)), F.col("_stored")
    known = stored.select(F.col(quote(key)).alias("_stored"))
    size = fresh.select(a).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(a.cast("string"))).alias("bytes")).first()
    if (size.bytes or 0) + 16 * size.n <= BROADCAST_BYTES:
        batch = F.broadcast(fresh.select(a.alias("_batch")))
        known = F.broadcast(known.join(batch, b.eqNullSafe(F.col("_batch")), "left_semi").distinct())
    return fresh.join(known, a.eqNullSafe(b), "left_anti")


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a CSV folder; every file carries the header once."""
    if not df.isEmpty():
        df.write.mode("append").option("header", True).csv(path)


# ---------------------------------------------------------------- snapshots


def version_name(at: dt.datetime | None = None) -> str:
    return (at or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d%H%M%S%f")


def write_snapshot(df: DataFrame, root: str, version: str | None = None, partition_by: list[str] | None = None) -> str:
    """Writes a table below ``root/version=...``; an existing version is never overwritten."""
    version = version or version_name()
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/version={version}")
    return version


def snapshot_versions(spark: SparkSession, root: str) -> list[str]:
    names = [n for n in paths.child_folders(spark, root) if n.startswith("version=")]
    return sorted(n.split("=", 1)[1] for n in names if paths.exists(spark, f"{root}/{n}/_SUCCESS"))


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A version of the table, by default the newest."""
    if version is None:
        found = snapshot_versions(spark, root)
        if not found:
            raise FileNotFoundError(f"no snapshot below {root}")
        version = found[-1]
    return spark.read.parquet(f"{root}/version={version}")
