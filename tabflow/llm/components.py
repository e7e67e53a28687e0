"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris and others, 2014).

Every step joins the edges with one row a node, written first, so a node with a third of all edges is split by Spark's skew join. No
neighbour list is gathered. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.shared import measured
from tabflow.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b. Large: every larger neighbour of a node to the smallest one; small: every smaller neighbour and the node itself."""
    if large:
        pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
    else:
        pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    least = materialize(pairs.groupBy("node").agg(F.min("other").alias("least")), "components-least")
    least = measured(least.select("node", F.least("least", "node").alias("least")))
    joined = pairs.join(least, "node")
    if large:
        moved = joined.filter(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("other").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return moved.filter("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of a table of links (a, b). Ids are not null; loops and repeats do no harm."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "components-edges")
    state = _state(edges)
    while state[0]:
        edges = materialize(_star(_star(edges, large=True), large=False), "components-edges")
        before, state = state, _state(edges)
        if before == state:
            break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(found.select("component", "component").distinct())
