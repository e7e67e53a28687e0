"""Left join with a table of unique keys, without sending all rows that lack a key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import quote

_SPREAD = 1000


def lookup(df: DataFrame, key: Column, table: DataFrame, table_key: str) -> DataFrame:
    """All columns of ``df``, and those of the row of ``table`` with the key (NULL where there is none).

    A hash join puts NULL keys into one partition. Here they carry a second key that differs by task, while every row of
    the table carries the one that rows with a key have. The number of rows stays, because table keys are unique. There
    is no broadcast hint: Spark broadcasts the table if its size is below the session's threshold.
    """
    left = df.withColumns({"_key": key, "_spread": F.when(key.isNull(), F.pmod(F.spark_partition_id(), F.lit(_SPREAD))).otherwise(F.lit(-1))})
    # Always -1, but not a literal: the optimizer would fold that into a filter, and the keys would collapse again.
    same = F.pmod(F.hash(F.col(quote(table_key))), F.lit(1)) - 1
    right = table.select("*", same.alias("_all"))
    joined = left.join(right, (F.col("_key") == F.col(quote(table_key))) & (F.col("_spread") == F.col("_all")), "left")
    return joined.drop("_key", "_spread", "_all")
