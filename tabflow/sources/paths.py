"""Folder listing through the Hadoop file system API, so that every Spark path scheme works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct sub-folders; versions of a table, so a short list."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Puts a file in another one's place."""
    fs, jpath = _fs(spark, target)
    fs.delete(jpath, False)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), jpath):
        raise OSError(f"{source} could not be moved to {target}")


def list_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """One row per file below ``path``: path, name, length, modified. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"))
