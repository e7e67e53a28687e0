"""Date formats and parsing of string columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")

# The accepted formats as Spark patterns, in the order they are tried.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS VV",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS 'Z'",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "dd-MMM-yyyy HH:mm:ss",
    "dd-MMM-yyyy",
    "MMM dd, yyyy",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
)


def parse_datetime(c: Column, fmt: str) -> Column:
    """The column parsed with one format; NULL where it does not fit. Never raises, also under ANSI mode."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days that lie between two timestamps (or dates), cut towards zero as a duration in days is."""
    return F.extract(F.lit("DAY"), later - earlier).cast("long")


def epoch_micros(c: Column, t: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp; for one without a zone, of its wall clock, whatever zone the session has."""
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    if isinstance(t, T.TimestampNTZType) and zone not in _UTC:
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return ((c - start).cast("decimal(18,6)") * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))
