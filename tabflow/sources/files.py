"""Scans of CSV and Parquet folders, in-memory frames, incremental and file-subset reads."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import quote, safe_cast
from tabflow.functions.types import spark_type
from tabflow.sources import paths
from tabflow.sources.schema import apply_types, infer_types

# Tokens that stand for a missing value in CSV input.
NULL_TOKENS = ("\\N", "\\\\N", "NULL")


@dataclass
class Source:
    """Where a dataset comes from: a folder or object-store prefix, or a frame that is already in Spark."""

    path: str | list[str] | None = None
    frame: DataFrame | None = None
    format: str | None = None
    schema: T.StructType | None = None
    columns: Mapping[str, str] | None = None
    view: Callable[[DataFrame], DataFrame] | str | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.frame is not None:
            df = self.frame
        elif self.path is None:
            raise ValueError("a source needs a path or a frame")
        else:
            df = scan(spark, self.path, format=self.format, schema=self.schema, columns=self.columns, **self.options)
        return apply_view(df, self.view)


def apply_view(df: DataFrame, view: Callable[[DataFrame], DataFrame] | str | None) -> DataFrame:
    """A view is a function of the source frame, or SQL text that names the frame ``{source}``."""
    if view is None:
        return df
    out = df.sparkSession.sql(view, source=df) if isinstance(view, str) else view(df)
    if not isinstance(out, DataFrame):
        raise TypeError("a view must return a DataFrame")
    return out


def scan(
    spark: SparkSession,
    path: str | list[str],
    format: str | None = None,
    schema: T.StructType | None = None,
    columns: Mapping[str, str] | None = None,
    file_filter: Callable[[Column], Column] | None = None,
    modified_after: dt.datetime | None = None,
    file_column: str | None = None,
    **options: Any,
) -> DataFrame:
    """All files below a folder as one frame. Where a folder holds Parquet and CSV, Parquet wins.

    ``file_filter`` gets the file name column; ``modified_after`` takes files changed later; ``file_column`` adds each row's file
    name. Further options go to the CSV reader.
    """
    if format is None:
        format = "parquet" if not paths.list_files(spark, path, "*.parquet").isEmpty() else "csv"
    if format == "parquet":
        return scan_parquet(spark, path, schema, file_filter, modified_after, file_column)
    if format == "csv":
        return scan_csv(spark, path, columns, schema, file_filter, modified_after, file_column, **options)
    raise ValueError(f"unknown format {format!r}")


def scan_parquet(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    file_filter: Callable[[Column], Column] | None = None,
    modified_after: dt.datetime | None = None,
    file_column: str | None = None,
) -> DataFrame:
    """Parquet below a folder. ``file_filter`` gets the file name column; Spark prunes whole files with it."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    if modified_after is not None:
        if schema is None:
            raise ValueError("an incremental scan needs a schema, because no file may match")
        reader = reader.option("modifiedAfter", _instant(modified_after))
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    if file_column is not None:
        df = df.select("*", F.col("_metadata.file_name").alias(file_column))
    if file_filter is not None:
        df = df.filter(file_filter(F.col("_metadata.file_name")))
    return df


def _instant(at: dt.datetime) -> str:
    return at.strftime("%Y-%m-%dT%H:%M:%S")


def scan_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; a run with ``availableNow`` reads the files that no run has read yet."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


_CSV_NAMES = "*.{csv,csv.gz}"


def _csv_reader(spark: SparkSession, modified_after: dt.datetime | None, options: Mapping[str, Any]):
    reader = spark.read.options(recursiveFileLookup=True, pathGlobFilter=_CSV_NAMES, **options)
    return reader if modified_after is None else reader.option("modifiedAfter", _instant(modified_after))


def _csv_heads(spark: SparkSession, path: str | list[str], file_filter, modified_after, options: Mapping[str, Any]) -> DataFrame:
    """file, head: the first line of every file, by Spark's own text reader, so that any path and its credentials work."""
    kept = {k: v for k, v in options.items() if k.lower() in ("linesep", "encoding")}
    lines = _csv_reader(spark, modified_after, {k: v for k, v in kept.items() if k.lower() == "linesep"}).text(path)
    lines = lines.filter("_metadata.file_block_start = 0")
    if file_filter is not None:
        lines = lines.filter(file_filter(F.col("_metadata.file_name")))
    line = F.col("value")
    for k, v in kept.items():
        if k.lower() == "encoding":
            line = F.decode(line.cast("binary"), v)
    # A text partition holds its lines in order, so the smallest number belongs to the first line.
    numbered = lines.select(F.col("_metadata.file_path").alias("file"), line.alias("line"), F.monotonically_increasing_id().alias("n"))
    return numbered.groupBy("file").agg(F.regexp_replace(F.min_by("line", "n"), "^\ufeff|\r$", "").alias("head"))


def _header_names(spark: SparkSession, head: str, options: Mapping[str, Any]) -> list[str]:
    """The names in a header line, split by Spark with the options of the scan."""
    plain = {k: v for k, v in options.items() if k.lower() not in ("linesep", "encoding", "header")}
    row = spark.read.options(**plain).csv(spark.sparkContext.parallelize([head], 1)).first()
    return [] if row is None else [name or f"_c{i}" for i, name in enumerate(row)]


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Mapping[str, str] | None = None,
    schema: T.StructType | None = None,
    file_filter: Callable[[Column], Column] | None = None,
    modified_after: dt.datetime | None = None,
    file_column: str | None = None,
    **options: Any,
) -> DataFrame:
    """CSV with a header. Files may order their columns differently; only columns found in every file are kept.

    ``columns`` maps names to semantic types; types of all other columns are inferred from the data of all files together.
    ``options`` are those of Spark's reader (``sep``, ``quote``, ``encoding`` and so on); the header is split with them, too. Only the distinct
    headers come to the driver, however many files there are.
    """
    heads = _csv_heads(spark, path, file_filter, modified_after, options)
    distinct = sorted(r["head"] for r in heads.select("head").distinct().collect())
    if not distinct:
        if schema is not None:
            return spark.createDataFrame([], schema if file_column is None else T.StructType([*schema.fields, T.StructField(file_column, T.StringType())]))
        raise FileNotFoundError(f"no CSV file below {path}")
    headers = [_header_names(spark, h, options) for h in distinct]
    shared = [c for c in headers[0] if all(c in h for h in headers)]
    cells = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(max(map(len, headers)))])
    rows = _csv_reader(spark, modified_after, {**options, "header": True}).schema(cells).csv(path)
    if file_filter is not None:
        rows = rows.filter(file_filter(F.col("_metadata.file_name")))
    extra = [] if file_column is None else [F.col("_metadata.file_name").alias(file_column)]
    if len(headers) == 1:
        text = rows.select(*[_missing(F.col(f"_{headers[0].index(c)}")).alias(c) for c in shared], *extra)
    else:
        # Each row takes its places from its own file's header.
        rows = rows.select("*", F.col("_metadata.file_path").alias("_path"), *extra).join(heads.select(F.col("file").alias("_path"), F.col("head").alias("_head")), "_path")
        cell = lambda c: F.coalesce(*[F.when(F.col("_head") == h, F.col(f"_{names.index(c)}")) for h, names in zip(distinct, headers, strict=True)])
        text = rows.select(*[_missing(cell(c)).alias(c) for c in shared], *([] if file_column is None else [F.col(quote(file_column))]))
    names = [] if file_column is None else [F.col(quote(file_column))]
    if schema is not None:
        return text.select(*[safe_cast(F.col(quote(f.name)), T.StringType(), f.dataType).alias(f.name) for f in schema.fields], *names)
    declared = dict(columns or {})
    inferred = infer_types(text, [c for c in shared if c not in declared])
    return apply_types(text, {**inferred, **{c: (t, None) for c, t in declared.items()}})


def _missing(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def scan_predefined(spark: SparkSession, path: str, schema: T.StructType | None = None, format: str | None = None, **lists: Sequence[str]) -> DataFrame:
    """One frame with a ``split`` column from lists of file names (no folder, no extension) per segment."""
    from tabflow.operators.split import PredefinedSplitter

    return PredefinedSplitter(**lists).read(spark, path, schema=schema, format=format)


def convert_to_parquet(
    df: DataFrame, target: str, columns: Mapping[str, str] | None = None, mode: str = "errorifexists"
) -> DataFrame:
    """Write a frame as Parquet with the given semantic types, and read it back."""
    if columns:
        types = {f.name: f.dataType for f in df.schema.fields}
        df = df.select(
            [
                safe_cast(F.col(quote(c)), types[c], spark_type(columns[c])).alias(c) if c in columns else F.col(quote(c))
                for c in df.columns
            ]
        )
    df.write.mode(mode).parquet(target)
    return df.sparkSession.read.parquet(target)
