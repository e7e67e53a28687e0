"""A user's function by group, where a group may be larger than a task.

Spark hands a group to Python as a whole. Groups beyond ``hot_rows`` rows are therefore cut into ranges of their order; the function
first reduces each range to a small state, the states of a group are merged in order, and then every range is computed by itself
with the state of all ranges before it. Other groups are computed in one piece.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import quote
from tabflow.operators.history import cut_hot_groups, hot_groups
from tabflow.session import cut_lineage

HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class GroupFunction:
    """What to compute by group. ``schema`` is what ``apply`` returns, as a DDL string; rows come in order.

    ``reduce`` gives the state of a range's rows, ``merge`` that of two ranges that follow each other, and ``apply`` the result for
    a range, given the state of all rows before it (None for the first range and for whole groups). A state is whatever JSON holds,
    and small. It must be enough for what comes after: ``apply`` gives the rows that it would give within the whole group.
    Functions that are defined inside another one travel to the executors whole; those of a module must be importable there.
    """

    schema: str
    apply: Callable[[pd.DataFrame, Any], pd.DataFrame]
    reduce: Callable[[pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]


def apply_by_group(df: DataFrame, group: str, order: Sequence[str], function: GroupFunction, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows that ``function`` gives for every group, NULL being a group, too. ``order`` must order the rows of a group fully.

    Without rows the result is empty. pandas holds whole numbers with NULLs among them as floats, so an order column that has NULLs
    is told apart up to 2**53.
    """
    if not function.schema or not order:
        raise ValueError("a function by group needs a schema, and an order of its rows")
    order, by = list(order), quote(group)
    apply, reduce, merge = function.apply, function.reduce, function.merge

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(order, na_position="first", kind="stable", ignore_index=True)

    hot = hot_groups(df, group, hot_rows)
    if hot.isEmpty():
        return df.groupBy(by).applyInPandas(lambda rows: apply(ordered(rows), None), function.schema)

    columns = df.columns
    known = hot.select("_hot_group", F.lit(True).alias("_is_hot"))
    marked = df.join(known, F.col(by).eqNullSafe(F.col("_hot_group")), "left").drop("_hot_group")
    is_hot = F.coalesce(F.col("_is_hot"), F.lit(False))
    ranged = cut_hot_groups(marked, is_hot, group, order, hot, hot_rows).drop("_is_hot")

    of_group = T.StructType([T.StructField("_group", df.schema[group].dataType)])
    state_schema = T.StructType([*of_group.fields, T.StructField("_of", T.LongType()), T.StructField("_state", T.StringType())])

    def reduced(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = json.dumps(reduce(ordered(rows[columns])))
        return pd.DataFrame({"_group": pd.Series([key[0]], dtype=rows[group].dtype), "_of": [key[1]], "_state": [state]})

    def chained(states: pd.DataFrame) -> pd.DataFrame:
        states, before, out = states.sort_values("_of", ignore_index=True), None, []
        for state in states["_state"]:
            out.append(None if before is None else json.dumps(before))
            before = json.loads(state) if before is None else merge(before, json.loads(state))
        return states.assign(_state=pd.Series(out, dtype=object))

    def applied(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        found = None if states.empty or states["_state"][0] is None else json.loads(states["_state"][0])
        return apply(ordered(rows[columns]), found)

    # One small row per hot group and range: the number of ranges bounds the length of a chain.
    states = ranged.filter("_range >= 0").groupBy(by, "_range").applyInPandas(reduced, state_schema)
    before = cut_lineage(states.groupBy("_group").applyInPandas(chained, state_schema))
    return ranged.groupBy(by, "_range").cogroup(before.groupBy("_group", "_of")).applyInPandas(applied, function.schema)
