"""Primary-key discovery, null reports and frame comparison."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import quote

_SKETCH_ERROR = 0.02


def primary_key_candidates(df: DataFrame) -> list[str]:
    """Columns with as many distinct values as rows, in column order.

    A sketch of every column in one pass leaves only columns that can be unique. Those are then counted exactly, all in one
    shuffle: each row becomes one row a column, and equal values combine in the map tasks, so a hot value does no harm.
    """
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    probe = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(F.col(quote(c)), _SKETCH_ERROR).alias(f"d{i}") for i, c in enumerate(plain)],
    ).first()
    possible = [c for i, c in enumerate(plain) if probe[f"d{i}"] >= probe.n * (1 - 8 * _SKETCH_ERROR) - 1]
    if not possible:
        return []
    texts = [c for c in possible if isinstance(df.schema[c].dataType, T.StringType)]
    # A digest stands for a long text; it is longer than the texts that stand for themselves, so the two never meet.
    values = [(F.when(F.length(quote(c)) <= 32, F.col(quote(c))).otherwise(F.sha2(quote(c), 256)) if c in texts else F.col(quote(c))).alias(f"c{i}") for i, c in enumerate(possible)]
    names = [f"c{i}" for i in range(len(possible))]
    counts = df.select(*values).groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names])
    repeated = counts.agg(F.grouping_id().alias("of"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("of").distinct().collect()
    # Of the bits of a grouping, the first column's is the highest; the column that is grouped by has a 0.
    every = (1 << len(names)) - 1
    found = {r.of for r in repeated}
    return [c for i, c in enumerate(possible) if every - (1 << (len(names) - 1 - i)) not in found]


def is_unique(df: DataFrame, key: Sequence[str]) -> bool:
    counts = df.groupBy(*[F.col(quote(c)) for c in key]).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > 1).isEmpty()


def primary_key(df: DataFrame) -> str:
    """The only candidate, or of several the first that has ``id`` as a part of its name."""
    found = primary_key_candidates(df)
    if not found:
        raise ValueError("no column has a distinct value in every row")
    if len(found) == 1:
        return found[0]
    for c in found:
        if re.search("id", c, re.IGNORECASE):
            return c
    raise ValueError(f"several columns are unique and none is named as an id: {found}")


def null_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns that hold at least one NULL, found in one pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(quote(c)).isNull()).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if counts[f"n{i}"]]


def null_report(df: DataFrame, by: str = "split", columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent per split and column, for columns that have any NULL in that split."""
    names = [c for c in (columns or df.columns) if c != by]
    counts = df.groupBy(quote(by)).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(quote(c)).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
    )
    long = counts.select(
        quote(by),
        "_rows",
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(names)])),
    )
    return long.filter(F.col("null_count") > 0).select(
        quote(by),
        "column",
        "null_count",
        F.round(F.lit(100.0) * F.col("null_count") / F.col("_rows"), 1).alias("null_percent"),
    )


def frame_diff(new: DataFrame, old: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key and column whose value differs: key, column, old_value, new_value, change.

    Both sides meet in one grouping by key, so every row is shuffled once and NULL is a key like any other. A key that
    repeats on one side has no counterpart to compare with; running the comparison then fails. Rows on one side only are
    reported once with the change ``added`` or ``removed``.
    """
    shared = [c for c in new.columns if c in old.columns and c not in key]
    keys = [F.col(quote(c)) for c in key]
    row = F.struct(*[F.col(quote(c)).alias(c) for c in shared])
    sides = new.select(*keys, row.alias("_new")).unionByName(old.select(*keys, row.alias("_old")), allowMissingColumns=True)
    met = sides.groupBy(*keys).agg(
        F.count("_new").alias("_n_new"), F.count("_old").alias("_n_old"), F.first("_new", True).alias("_new"), F.first("_old", True).alias("_old")
    )
    message = F.lit(f"the key {list(key)} repeats in one of the frames")
    differs = F.when((F.col("_n_new") > 1) | (F.col("_n_old") > 1), F.raise_error(message)).otherwise(~F.col("_new").eqNullSafe(F.col("_old")))
    both = met.filter(differs)
    field = lambda side, c: F.col(side).getField(c)
    rows = [
        F.when(
            F.col("_new").isNotNull() & F.col("_old").isNotNull() & ~field("_new", c).eqNullSafe(field("_old", c)),
            F.struct(
                F.lit("changed").alias("change"),
                F.lit(c).alias("column"),
                field("_old", c).cast("string").alias("old_value"),
                field("_new", c).cast("string").alias("new_value"),
            ),
        )
        for c in shared
    ]
    nothing = F.lit(None).cast("string")
    whole = F.when(
        F.col("_new").isNull() | F.col("_old").isNull(),
        F.struct(
            F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"),
            nothing.alias("column"),
            nothing.alias("old_value"),
            nothing.alias("new_value"),
        ),
    )
    return both.select(*keys, F.inline(F.array_compact(F.array(whole, *rows))))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows with the same number of copies.

    Copies are counted before the comparison, so a row that repeats often costs one row of the shuffle.
    """
    cols = [F.col(quote(c)) for c in a.columns]
    if sorted(a.columns) != sorted(b.columns):
        return False
    tagged = a.select(*cols, F.lit(1).alias("_side")).unionByName(b.select(*cols, F.lit(-1).alias("_side")))
    return tagged.groupBy(*cols).agg(F.sum("_side").alias("_d")).filter(F.col("_d") != 0).isEmpty()
