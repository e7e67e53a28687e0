"""Semantic column types, their Spark types, and the widening rules used to unify schemas."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import types as T


class SchemaConflict(ValueError):
    """Two files give one column types that have no common type."""


# Semantic type names and the Spark type each is stored as.
SPARK_TYPES: dict[str, T.DataType] = {
    "float": T.DoubleType(),
    "integer": T.LongType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
    "date": T.DateType(),
    "string": T.StringType(),
    "text": T.StringType(),
    "categorical": T.StringType(),
    "null": T.StringType(),
    "array": T.ArrayType(T.FloatType()),
}

# Imputation methods and encodings allowed for each semantic type.
IMPUTE_METHODS = {
    "float": ("most_frequent", "ffill", "mean", "median", "constant"),
    "integer": ("most_frequent", "ffill", "mean", "median", "constant"),
    "boolean": ("ffill", "most_frequent", "constant"),
    "datetime": ("ffill", "today", "constant"),
    "date": ("ffill", "today", "constant"),
    "string": ("ffill", "most_frequent", "constant"),
    "text": ("ffill", "most_frequent", "constant"),
    "categorical": ("ffill", "categorical", "most_frequent", "constant"),
}
ENCODINGS = {
    "categorical": ("embedding", "one_hot", "ordinal"),
    "boolean": ("one_hot", "ordinal"),
    "string": ("embedding",),
    "text": ("embedding",),
}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REALS = (T.FloatType, T.DoubleType, T.DecimalType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, _INTEGERS)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, _INTEGERS + _REALS)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def spark_type(semantic: str) -> T.DataType:
    try:
        return SPARK_TYPES[semantic]
    except KeyError:
        raise ValueError(f"unknown semantic type {semantic!r}; known: {sorted(SPARK_TYPES)}") from None


def semantic_type(t: T.DataType) -> str:
    """The semantic type a physical type stands for; categorical and text need the data (see sources.schema)."""
    if is_integer(t):
        return "integer"
    if isinstance(t, _REALS):
        return "float"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.DateType):
        return "date"
    if is_temporal(t):
        return "datetime"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.StringType):
        return "string"
    raise ValueError(f"type {t.simpleString()} has no semantic type")


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """Smallest common type of two columns of the same name; raises SchemaConflict where there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if is_integer(a) and is_integer(b):
        return max(a, b, key=lambda t: _INTEGERS.index(type(t)))
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    if is_numeric(a) and is_numeric(b):
        for decimal, other in ((a, b), (b, a)):
            if isinstance(decimal, T.DecimalType):
                if isinstance(other, T.LongType) and decimal.scale == 0:
                    return decimal
                if isinstance(other, T.DoubleType) and decimal.scale > 0:
                    return decimal
        return T.DoubleType()
    raise SchemaConflict(f"no common type for {a.simpleString()} and {b.simpleString()}")


def common_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """Columns present in every schema, in the order of the first, each with the widened type."""

    def fold(left: T.StructType, right: T.StructType) -> T.StructType:
        names = set(right.names)
        fields = []
        for f in left.fields:
            if f.name in names:
                try:
                    fields.append(T.StructField(f.name, widen(f.dataType, right[f.name].dataType), True))
                except SchemaConflict as e:
                    raise SchemaConflict(f"column {f.name}: {e}") from None
        return T.StructType(fields)

    schemas = list(schemas)
    if not schemas:
        raise ValueError("no schemas to unify")
    return reduce(fold, schemas[1:], fold(schemas[0], schemas[0]))


def storable(schema: T.StructType) -> T.StructType:
    """The schema with NullType columns as strings, because Parquet has no null type."""
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType, True)
            for f in schema.fields
        ]
    )
