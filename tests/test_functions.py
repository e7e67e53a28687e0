import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import clip, empty_to_null, safe_cast, virtual_name
from tabflow.functions.dates import DATE_FORMATS, days_between, epoch_micros, parse_datetime
from tabflow.functions.types import SchemaConflict, common_schema, semantic_type, spark_type, storable, widen
from tests.conftest import rows

L, I, S, D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()


@pytest.mark.parametrize(
    "a, b, expected",
    [
        (T.ByteType(), L, L),
        (I, T.ShortType(), I),
        (L, T.DecimalType(20, 0), T.DecimalType(20, 0)),
        (T.DecimalType(20, 0), L, T.DecimalType(20, 0)),
        (S, L, S),
        (T.BooleanType(), S, S),
        (D, T.DecimalType(10, 2), T.DecimalType(10, 2)),
        (T.FloatType(), L, D),
        (L, D, D),
        (T.NullType(), D, D),
        (D, T.NullType(), D),
        (T.BooleanType(), T.BooleanType(), T.BooleanType()),
    ],
)
def test_widening(a, b, expected):
    assert widen(a, b) == expected


def test_types_without_a_common_type_raise():
    with pytest.raises(SchemaConflict):
        widen(T.BooleanType(), T.TimestampType())


def test_common_schema_keeps_shared_columns_in_first_order():
    a = T.StructType().add("x", L).add("y", S).add("z", L)
    b = T.StructType().add("z", D).add("x", L)
    assert common_schema([a, b]) == T.StructType().add("x", L).add("z", D)
    assert storable(T.StructType().add("n", T.NullType()))["n"].dataType == S


def test_semantic_types_round_trip():
    for name in ("float", "integer", "boolean", "datetime", "date", "string", "array"):
        assert semantic_type(spark_type(name)) == name
    assert semantic_type(T.DecimalType(10, 2)) == "float"


# One written value per format, all of them the second of January 2024 (with a time where the format has one).
SAMPLES = [
    "2024-01-02 03:04:05.000006 UTC",
    "2024-01-02T03:04:05.000006",
    "2024-01-02 03:04:05.007 Z",
    "2024-01-02 03:04:05.007",
    "2024-01-02 03:04:05",
    "2024-01-02 03:04",
    "2024-01-02",
    "01/02/2024 03:04:05",
    "01/02/2024",
    "02-01-2024",
    "02-Jan-2024 03:04:05",
    "02-Jan-2024",
    "Jan 02, 2024",
    "2024/01/02 03:04:05",
    "2024/01/02",
]


def test_every_date_format_parses_its_sample(spark):
    row = spark.range(1).select(*[parse_datetime(F.lit(s), f).alias(str(i)) for i, (s, f) in enumerate(zip(SAMPLES, DATE_FORMATS))]).first()
    assert len(SAMPLES) == len(DATE_FORMATS)
    assert all(v is not None and (v.year, v.month, v.day) == (2024, 1, 2) for v in row)
    assert spark.range(1).select(parse_datetime(F.lit("no date"), DATE_FORMATS[4])).first()[0] is None


def test_days_between_is_cut_towards_zero(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-03 01:00:00' a, timestamp_ntz'2024-01-01 02:00:00' b")
    assert df.select(days_between(F.col("a"), F.col("b")), days_between(F.col("b"), F.col("a"))).first() == (1, -1)


def test_wall_clock_order_survives_a_change_to_summer_time(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-03-10 02:30:00.000001', timestamp_ntz'2024-03-10 03:10:00')) t")
    want = [1710037800000001, 1710040200000000]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r[0] for r in df.select(epoch_micros(F.col("t"), T.TimestampNTZType())).collect()] == want
        apart = spark.sql("SELECT timestamp_ntz'2024-03-11 02:00:00' a, timestamp_ntz'2024-03-10 01:30:00' b, date'2024-03-12' c, date'2024-03-10' d")
        assert apart.select(days_between(F.col("a"), F.col("b")), days_between(F.col("c"), F.col("d"))).first() == (1, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[0] for r in df.select(epoch_micros(F.col("t"), T.TimestampNTZType())).collect()] == want


def test_clip_leaves_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-5.0,), (5.0,), (50.0,)], "v double")
    out = [r[0] for r in df.select(clip(F.col("v"), None, 10)).collect()]
    assert out[0] is None and math.isnan(out[1]) and out[2:] == [0.0, 5.0, 10.0]


def test_safe_cast(spark):
    df = spark.createDataFrame([("true",), ("TRUE",), ("12",), (None,)], "s string")
    assert [r[0] for r in df.select(safe_cast(F.col("s"), S, T.BooleanType())).collect()] == [True, False, False, None]
    assert [r[0] for r in df.select(safe_cast(F.col("s"), S, L)).collect()] == [None, None, 12, None]
    with pytest.raises(TypeError):
        safe_cast(F.col("d"), D, T.BooleanType())


def test_empty_strings_become_null_in_string_columns_only(spark):
    df = spark.createDataFrame([("", 0), ("a", 1)], "s string, n int")
    assert rows(empty_to_null(df)) == [(None, 0), ("a", 1)]


def test_virtual_names_replace_hyphens():
    assert virtual_name("p", "4-NOT SPECIFIED") == "p_4_NOT SPECIFIED"
    assert virtual_name("p", True) == "p_true"
