"""One-hot and ordinal encoding, decoding, and embedding columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import embedding_name, quote, virtual_name
from tabflow.operators.impute import OTHER
from tabflow.operators.lookup import lookup
from tabflow.operators.stats import Categories


# A literal map is searched from its start for every row; longer ones are joined instead.
MAP_LIMIT = 64


def one_hot_values(categories: Categories, categorical: bool = True) -> list:
    """The allowed values in order; categoricals end with ``other``. Each becomes a column, so however many there are, they are listed."""
    values = categories.values
    if not categories.inline:
        values = [r["value"] for r in categories.table.orderBy("label").select("value").collect()]
    extra = [OTHER] if categorical and OTHER not in values else []
    return [*values, *extra]


def one_hot(c: Column, column: str, values: list) -> list[Column]:
    """One boolean column per value, by equality of text. NULL gives NULLs."""
    text = c.cast("string")
    return [(text == F.lit(str(v).lower() if isinstance(v, bool) else str(v))).alias(virtual_name(column, v)) for v in values]


def ordinal(c: Column, categories: Categories) -> Column:
    """The number of the value among the allowed ones; values not seen in training, and NULL, get the next number."""
    labels = categories.labels()
    unseen = F.lit(len(labels)).cast("long")
    if not labels:
        return unseen
    pairs = [F.lit(x) for v, i in labels.items() for x in (_text(v), i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c.cast("string")).cast("long"), unseen)


def _text(v: Any) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def encode_one_hot(df: DataFrame, column: str, categories: Categories, categorical: bool = True) -> DataFrame:
    values = one_hot_values(categories, categorical)
    rest = [F.col(quote(c)) for c in df.columns if c != column]
    return df.select(*rest, *one_hot(F.col(quote(column)), column, values))


def encode_ordinal(df: DataFrame, column: str, categories: Categories) -> DataFrame:
    """In place. Beyond a short literal map the labels are joined; their number is the code for unseen values."""
    if categories.inline and len(categories.values) <= MAP_LIMIT:
        return df.select([ordinal(F.col(quote(c)), categories).alias(c) if c == column else F.col(quote(c)) for c in df.columns])
    if categories.inline:
        pairs = [(_text(v), i) for v, i in categories.labels().items()]
        labels = F.broadcast(df.sparkSession.createDataFrame(pairs, "_value string, _label long"))  # at most MAX_INLINE rows
        unseen = len(pairs)
    else:
        labels = categories.table.select(F.col("value").alias("_value"), F.col("label").alias("_label"))
        unseen = categories.table.count()
    joined = lookup(df, F.col(quote(column)).cast("string"), labels, "_value")
    code = F.coalesce(F.col("_label"), F.lit(unseen).cast("long"))
    return joined.select([code.alias(c) if c == column else F.col(quote(c)) for c in df.columns])


def decode(c: Column, categories: Categories) -> Column:
    """The value of an ordinal code; unknown codes give NULL."""
    labels = categories.labels()
    if not labels:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for v, i in labels.items() for x in (i, _text(v))]
    return F.try_element_at(F.create_map(*pairs), c.cast("int"))


def decode_values(codes: list[int], categories: Categories) -> list:
    """The values of a short list of codes; None for unknown ones."""
    return [categories.values[i] if 0 <= i < len(categories.values) else None for i in codes]


def decode_column(df: DataFrame, column: str, categories: Categories) -> DataFrame:
    if categories.inline:
        return df.select([decode(F.col(quote(c)), categories).alias(c) if c == column else F.col(quote(c)) for c in df.columns])
    labels = categories.table.select(F.col("value").alias("_value"), F.col("label").alias("_label"))
    joined = lookup(df, F.col(quote(column)).cast("long"), labels, "_label")
    return joined.select([F.col("_value").alias(c) if c == column else F.col(quote(c)) for c in df.columns])


def explode_embedding(df: DataFrame, column: str, dimensions: int | None = None, source: str | None = None) -> DataFrame:
    """The vector column becomes one column per dimension, ``{column}_embedding_{i}``; by default all of the longest vector."""
    vector = source or embedding_name(column)
    if dimensions is None:
        dimensions = df.agg(F.max(F.size(quote(vector)))).first()[0] or 0
    rest = [F.col(quote(c)) for c in df.columns if c != vector]
    parts = [F.get(F.col(quote(vector)), F.lit(i)).alias(f"{embedding_name(column)}_{i}") for i in range(dimensions)]
    return df.select(*rest, *parts)
