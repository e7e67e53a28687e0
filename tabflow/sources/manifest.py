"""What a folder of Parquet files held when it was last read: files, their times and sizes, and a digest of each file's rows.

A listing that is joined with the last manifest tells added, replaced and deleted files, also those replaced by older ones, which a
modification time alone does not show. Row digests are sums, so those of files add up to that of the table: a refresh reads the rows of
added and replaced files only, and the fingerprint of the whole folder follows from the manifest.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import row_digest
from tabflow.session import materialize
from tabflow.sources.schema import fingerprint_of
from tabflow.sources.store import snapshot_versions

#: Up to so many files are named one by one, so that Spark lists and opens no others; beyond, rows are matched by their file.
NAMED_FILES = 10_000
_FILE = "file string, length long, modified timestamp, num_rows long, x long, s decimal(38,0)"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """file, length, modified of every Parquet file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    m = lambda c: F.col(f"_metadata.{c}")
    return files.select(m("file_path").alias("file"), m("file_size").alias("length"), m("file_modification_time").alias("modified"))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """file, change (added, replaced, deleted, same), and length and modified as they are now, from a listing and a manifest."""
    a, b = now.alias("a"), before.select("file", "length", "modified").alias("b")
    joined = a.join(b, F.col("a.file") == F.col("b.file"), "full_outer")
    same = F.col("a.length").eqNullSafe(F.col("b.length")) & F.col("a.modified").eqNullSafe(F.col("b.modified"))
    change = F.when(F.col("b.file").isNull(), "added").when(F.col("a.file").isNull(), "deleted").when(same, "same").otherwise("replaced")
    return joined.select(F.coalesce("a.file", "b.file").alias("file"), change.alias("change"), F.col("a.length").alias("length"), F.col("a.modified").alias("modified"))


def rows_of(spark: SparkSession, path: str, files: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the named files below a folder, with ``_file``. Other files are not opened while the names are few enough to be listed."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"))
    named = [r.file for r in files.select("file").limit(NAMED_FILES + 1).collect()]
    if len(named) <= NAMED_FILES:
        return rows.filter(F.col("_metadata.file_path").isin(named)) if named else rows.filter(F.lit(False))
    return rows.join(files.select(F.col("file").alias("_file")), "_file", "left_semi")


def file_digests(rows: DataFrame) -> DataFrame:
    """file, num_rows, x, s: the parts of a fingerprint that add up over files."""
    h = row_digest([c for c in rows.columns if c != "_file"]).alias("h")
    each = rows.select("_file", h).groupBy(F.col("_file").alias("file"))
    return each.agg(F.count(F.lit(1)).alias("num_rows"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))


@dataclass
class Refreshed:
    version: int
    files: DataFrame  #: file, change, length, modified, num_rows: of every file now and of every deleted one
    manifest: DataFrame  #: one row a file

    def changed(self) -> DataFrame:
        return self.files.filter("change IN ('added', 'replaced')")


class Manifest:
    """Versions of a manifest below a folder of their own."""

    def __init__(self, spark: SparkSession, path: str, root: str, schema: T.StructType):
        """``path`` holds the data, ``root`` the manifests; ``schema`` is that of the rows whose digests are kept."""
        # As Spark's readers do, which take no promise about NULLs from a schema.
        nullable = re.sub(r'"(nullable|containsNull|valueContainsNull)":false', r'"\1":true', schema.json())
        self.spark, self.path, self.root, self.schema = spark, path, root, T.StructType.fromJson(json.loads(nullable))

    def versions(self) -> list[int]:
        return sorted(int(v) for v in snapshot_versions(self.spark, self.root))

    def read(self, version: int | None = None) -> DataFrame:
        """One row a file; no rows before the first refresh."""
        found = self.versions()
        if version is None and not found:
            return self.spark.createDataFrame([], _FILE)
        return self.spark.read.schema(_FILE).parquet(f"{self.root}/version={found[-1] if version is None else version}")

    def refresh(self) -> Refreshed:
        """Compares the folder with the newest manifest, reads what is new, and writes the next version.

        Files that were neither added nor replaced keep their digests unread. A file without rows has the sum 0. The new version counts
        from the moment its folder is complete; a refresh that is lost half-way leaves the last one in force.
        """
        before, number = self.read(), (self.versions() or [0])[-1] + 1
        found = materialize(changes(listing(self.spark, self.path), before), "manifest-changes")
        fresh = found.filter("change IN ('added', 'replaced')")
        digests = file_digests(rows_of(self.spark, self.path, fresh, self.schema))
        zero = F.lit(0).cast("long")
        read = fresh.join(digests, "file", "left").select(
            "file", "length", "modified", F.coalesce("num_rows", zero).alias("num_rows"), F.coalesce("x", zero).alias("x"), F.coalesce("s", zero.cast("decimal(38,0)")).alias("s")
        )
        kept = before.join(found.filter("change = 'same'").select("file"), "file", "left_semi").select(*read.columns)
        kept.unionByName(read).write.parquet(f"{self.root}/version={number}")
        now = self.read(number)
        counts = now.select("file", "num_rows").unionByName(before.join(found.filter("change = 'deleted'").select("file"), "file", "left_semi").select("file", "num_rows"))
        return Refreshed(number, found.join(counts, "file"), now)

    def fingerprint(self, version: int | None = None) -> DataFrame:
        """num_rows and fingerprint of the folder, as those of all its rows together, from the manifest alone."""
        m = self.read(version).agg(F.coalesce(F.sum("num_rows"), F.lit(0)).alias("num_rows"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
        rows = F.col("num_rows") > 0
        return fingerprint_of(m.select("num_rows", F.when(rows, F.col("x")).alias("x"), F.when(rows, F.col("s")).alias("s")), self.schema)
