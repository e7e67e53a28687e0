"""Schema unification across files, schema improvement, type inference and fingerprints."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import quote, row_digest, safe_cast
from tabflow.functions.dates import DATE_FORMATS, parse_datetime
from tabflow.functions.types import common_schema, spark_type, storable
from tabflow.sources import paths

# Fixed values of the categorical-or-text rule.
TEXT_IF_TOP_SHARE_BELOW = 0.10
TEXT_IF_MORE_DISTINCT_THAN = 100

_WHOLE = r"^\s*[+-]?\d{1,19}\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

TypeMap = dict[str, tuple[str, str | None]]


# ---------------------------------------------------------------- unification across files


def footer_schemas(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, schema (JSON) of every Parquet file below a folder. Footers are read in tasks, not on the driver."""

    def footers(batches):
        from pyarrow import fs, parquet
        from pyspark.sql.pandas.types import from_arrow_schema

        for batch in batches:
            found = []
            for uri in batch["path"]:
                filesystem, local = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://").replace("file:///", "/").replace("file:/", "/"))
                with filesystem.open_input_file(local) as f:
                    schema = parquet.ParquetFile(f).schema_arrow
                found.append(from_arrow_schema(schema, prefer_timestamp_ntz=True).json())
            yield pd.DataFrame({"path": batch["path"], "schema": found})

    return paths.list_files(spark, path, "*.parquet").select("path").mapInPandas(footers, "path string, schema string")


def scan_unified(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet files with differing schemas as one frame: shared columns only, each with its widened type.

    Where all files agree, which is usual, the folder is read as it is. Otherwise each schema's files are one scan.
    """
    footers = footer_schemas(spark, path)
    groups = footers.groupBy("schema").agg(F.count(F.lit(1)).alias("n")).collect()
    if not groups:
        raise FileNotFoundError(f"no Parquet file below {path}")
    if len(groups) == 1:
        schema = T.StructType.fromJson(json.loads(groups[0]["schema"]))
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(schema).parquet(path)
    # Only file names come to the driver, where a scan of many files keeps them in any case.
    rows = footers.groupBy("schema").agg(F.sort_array(F.collect_list("path")).alias("files")).collect()
    rows.sort(key=lambda r: r.files[0])
    return unify([spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).parquet(*r.files) for r in rows])


def unify(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames by name over their shared columns, cast to the widened types."""
    target = storable(common_schema([f.schema for f in frames]))
    out = None
    for frame in frames:
        part = frame.select([F.col(quote(f.name)).try_cast(f.dataType).alias(f.name) for f in target.fields])
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- improvement and inference


def date_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The first format that fits every non-null value, for each string column that has one.

    One pass finds a sample value of every column; the second one is that of ``fitting_formats``.
    """
    if not columns:
        return {}
    probe = df.agg(*[_sample(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return fitting_formats(df, {c: probe[f"c{i}"] for i, c in enumerate(columns)})


def _sample(name: str):
    return F.any_value(F.col(quote(name)), F.lit(True))


def fitting_formats(df: DataFrame, samples: Mapping[str, str | None]) -> dict[str, str]:
    """The same, given any non-null value of each column. Only formats that fit it can fit the column, so one pass checks one or
    two formats for few columns instead of all formats for all columns; without such columns there is no pass."""
    plausible = [c for c, v in samples.items() if v is not None]
    if not plausible:
        return {}
    one_row = df.sparkSession.range(1).select(
        *[parse_datetime(F.lit(samples[c]), f).isNotNull().alias(f"c{i}_{j}") for i, c in enumerate(plausible) for j, f in enumerate(DATE_FORMATS)]
    ).first()
    checks = [(c, j) for i, c in enumerate(plausible) for j in range(len(DATE_FORMATS)) if one_row[f"c{i}_{j}"]]
    if not checks:
        return {}
    misses = df.agg(
        *[
            F.count_if(F.col(quote(c)).isNotNull() & parse_datetime(F.col(quote(c)), DATE_FORMATS[j]).isNull()).alias(f"k{n}")
            for n, (c, j) in enumerate(checks)
        ]
    ).first()
    fits: dict[str, str] = {}
    for n, (c, j) in enumerate(checks):
        if misses[f"k{n}"] == 0:
            fits.setdefault(c, DATE_FORMATS[j])
    return fits


def convert_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns whose values all fit one known format become datetimes; others stay as they are."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    found = date_formats(df, strings)
    return df.select([parse_datetime(F.col(quote(c)), found[c]).alias(c) if c in found else F.col(quote(c)) for c in df.columns])


def improve(df: DataFrame) -> DataFrame:
    """Fractional columns that hold only whole numbers become integers; strings that are all dates become datetimes."""
    reals = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))]
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

    def fraction(name: str):
        c = F.col(quote(name))
        return c.isNotNull() & ~F.coalesce(c.try_cast("bigint").cast(df.schema[name].dataType) == c, F.lit(False))

    checks = [F.struct(F.count(F.col(quote(c))).alias("n"), F.count_if(fraction(c)).alias("bad")).alias(f"r{i}") for i, c in enumerate(reals)]
    checks += [_sample(c).alias(f"s{i}") for i, c in enumerate(strings)]
    if not checks:
        return df
    found = df.agg(*checks).first()
    whole = {c for i, c in enumerate(reals) if found[f"r{i}"].n > 0 and found[f"r{i}"].bad == 0}
    dates = fitting_formats(df, {c: found[f"s{i}"] for i, c in enumerate(strings)})
    out = []
    for name in df.columns:
        c = F.col(quote(name))
        if name in whole:
            c = c.cast("bigint").alias(name)
        elif name in dates:
            c = parse_datetime(c, dates[name]).alias(name)
        out.append(c)
    return df.select(out)


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> TypeMap:
    """Semantic type, and date format where there is one, for each column.

    String columns: whole numbers, numbers, booleans, dates, and else categorical or text. A column whose estimated
    distinct count is far beyond the limit of the rule is text without counting its values, so only columns with few
    values are grouped, and that grouping stays small whatever the number of rows.
    """
    names = list(columns if columns is not None else df.columns)
    out: TypeMap = {}
    strings = []
    for name in names:
        t = df.schema[name].dataType
        if isinstance(t, T.StringType):
            strings.append(name)
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            out[name] = ("float", None)
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out[name] = ("integer", None)
        elif isinstance(t, T.BooleanType):
            out[name] = ("boolean", None)
        elif isinstance(t, T.DateType):
            out[name] = ("date", None)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            out[name] = ("datetime", None)
        elif isinstance(t, T.ArrayType):
            out[name] = ("array", None)
        else:
            out[name] = ("categorical", None)
    if not strings:
        return out

    def shape(name: str):
        c = F.col(quote(name))
        return F.struct(
            F.count(c).alias("n"),
            F.count_if(c.isNotNull() & ~(c.rlike(_WHOLE) & c.try_cast("bigint").isNotNull())).alias("not_whole"),
            F.count_if(c.isNotNull() & ~c.rlike(_NUMBER)).alias("not_number"),
            F.count_if(c.isNotNull() & ~F.lower(c).isin("true", "false")).alias("not_bool"),
            F.approx_count_distinct(c).alias("distinct"),
            _sample(name).alias("sample"),
        )

    shapes = df.agg(*[shape(c).alias(f"c{i}") for i, c in enumerate(strings)]).first()
    undecided = []
    for i, name in enumerate(strings):
        s = shapes[f"c{i}"]
        if s.n == 0:
            out[name] = ("categorical", None)
        elif s.not_whole == 0:
            out[name] = ("integer", None)
        elif s.not_number == 0:
            out[name] = ("float", None)
        elif s.not_bool == 0:
            out[name] = ("boolean", None)
        else:
            undecided.append((name, s))
    dates = fitting_formats(df, {n: s.sample for n, s in undecided})
    few = []
    for name, s in undecided:
        if name in dates:
            out[name] = ("datetime", dates[name])
        elif s.distinct > 2 * TEXT_IF_MORE_DISTINCT_THAN:
            out[name] = ("text", None)
        else:
            few.append(name)
    if few:
        for row in category_shares(df, few).collect():
            text = row.top_share < TEXT_IF_TOP_SHARE_BELOW or row.n_distinct > TEXT_IF_MORE_DISTINCT_THAN
            out[row.column] = ("text" if text else "categorical", None)
    return {n: out[n] for n in names}


def category_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, n_distinct, top_share of string columns. Long values are compared by their SHA-256."""
    value = lambda c: F.when(F.length(c) <= 64, c).otherwise(F.sha2(c, 256))
    pairs = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), value(F.col(quote(c))).alias("value")) for c in columns]))
    )
    counts = pairs.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("column").agg(
        F.sum("k").alias("n"),
        F.count(F.lit(1)).alias("n_distinct"),
        (F.max("k") / F.sum("k")).alias("top_share"),
    )


def apply_types(df: DataFrame, types: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Cast each column to the type found by ``infer_types`` (or declared); values that do not fit become NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if f.name in types:
            semantic, fmt = types[f.name]
            if fmt is not None:
                c = parse_datetime(c, fmt)
            elif isinstance(f.dataType, T.StringType) and semantic in ("integer", "float"):
                c = F.trim(c).try_cast(spark_type(semantic))
            elif isinstance(f.dataType, T.StringType) and semantic == "boolean":
                c = F.lower(c) == F.lit("true")
            else:
                c = safe_cast(c, f.dataType, spark_type(semantic))
        out.append(c.alias(f.name))
    return df.select(out)


# ---------------------------------------------------------------- fingerprint


def fingerprint(df: DataFrame) -> DataFrame:
    """One row with the SHA-256 of schema, row count and an order-independent digest of all values."""
    h = row_digest(df.columns)
    summary = df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.bit_xor("h").alias("x"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
    )
    return fingerprint_of(summary, df.schema)


def fingerprint_of(summary: DataFrame, schema: T.StructType) -> DataFrame:
    """num_rows and fingerprint from the number of rows and the sums ``x`` and ``s`` of their digests."""
    text = F.concat_ws("|", F.lit(schema.json()), F.col("num_rows").cast("string"), F.col("x").cast("string"), F.col("s").cast("string"))
    return summary.select("num_rows", F.sha2(text, 256).alias("fingerprint"))
