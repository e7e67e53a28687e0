"""URL filter by a tree of path templates: what rules say about some urls is carried to urls of the same template.

Rules name a verdict, a host and the start of a path, and judge the urls that they fit. For the others each host has a tree of its
paths, one level a segment, at most ``depth`` levels (what is deeper shares one node ``**``). Digits in a segment are a variable field
(``#``). On each level, from the top:

- a segment with fewer than ``least`` different paths below its node is variable and becomes the wildcard ``*``;
- the other branches of a node are compared by three shares of their paths: judged by a rule, blocked by one, ending there. Branches in
  one cell of a grid of eighths are alike; cells in order are merged with the one before if no share differs by more than Hoeffding's
  bound allows, ``spread * (1 / sqrt(n1) + 1 / sqrt(n2))``. Merged branches go on as one, named by their first segment in braces.

A template is rejected if its smoothed purity, (blocked + weight * prior) / (judged + weight), is above ``reject``. Counts are of
different paths, so copies of a url are no evidence. No step gathers a host or a node: counts combine in the map tasks, a node hands on
at most 9**3 cells, and rows meet the tree in salted joins.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.shared import measured
from tabflow.session import materialize

DEPTH = 5
LEAST = 8
SPREAD = 1.36
PRIOR, WEIGHT, REJECT = 0.25, 4.0, 0.5
SALTS = 8
_SHARES = ("judged", "blocked", "ends")


class Rule(NamedTuple):
    verdict: str  #: allow or block
    host: str  #: this host and all its subdomains
    path: str  #: what the path starts with

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    cut = lambda group: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(cut(1), string.ascii_uppercase, string.ascii_lowercase), cut(2)


def fitting_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as (rule, verdict); of equally long ones a blocking one. Null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _segments(path: Column) -> Column:
    """Masked segments; none for an empty path. Braces and stars are written as in urls, so wildcards cannot be met in a path."""
    plain = F.replace(F.replace(path, F.lit("*"), F.lit("%2A")), F.lit("{"), F.lit("%7B"))
    cut = F.split(F.regexp_replace(F.regexp_replace(plain, "^/", ""), "[0-9]+", "#"), "/", -1)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(cut)


def _met(rows: DataFrame, table: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Left join with a written table of unique keys, which is repeated once a salt unless it is small enough for broadcast."""
    small = measured(table)
    if small is not table:
        return rows.join(small, keys, "left")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")


def _branches(nodes: DataFrame, least: int, spread: float) -> DataFrame:
    """(host, template, token, label) of the segments that stay, similar ones under one label."""
    eighth = {f"{s}8": F.floor(8 * F.col(s) / F.col("n")) for s in _SHARES}
    literal = nodes.filter(F.col("n") >= least).withColumns(eighth)
    grid = ["host", "template", "blocked8", "judged8", "ends8"]
    cells = literal.groupBy(*grid).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in _SHARES], F.min("token").alias("token"), F.count("*").alias("tokens"))
    order = Window.partitionBy("host", "template").orderBy("blocked8", "judged8", "ends8")
    before = {c: F.lag(c).over(order) for c in ("n", *_SHARES)}
    bound = F.lit(spread) * (1 / F.sqrt(F.col("n")) + 1 / F.sqrt(before["n"]))
    differs = F.greatest(*[F.abs(F.col(s) / F.col("n") - before[s] / before["n"]) for s in _SHARES]) > bound
    cells = cells.withColumn("new", F.coalesce(differs, F.lit(True)).cast("int")).withColumn("branch", F.sum("new").over(order))
    named = Window.partitionBy("host", "template", "branch")
    first = F.min("token").over(named)
    label = F.when(F.sum("tokens").over(named) == 1, first).otherwise(F.concat(F.lit("{"), first, F.lit("}")))
    return literal.select(*grid, "token").join(cells.select(*grid, label.alias("label")), grid).select("host", "template", "token", "label")


def path_templates(paths: DataFrame, depth: int = DEPTH, least: int = LEAST, spread: float = SPREAD) -> DataFrame:
    """For different (host, path) rows with judged and blocked as 0 or 1: the template of each path, level by level."""
    rows = materialize(paths.select("host", "path", "judged", "blocked", _segments(F.col("path")).alias("segments"), F.lit("").alias("template")), "url-paths")
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for k in range(min(depth, deepest)):
        here = F.size("segments") > k
        at = rows.withColumn("token", F.when(here, F.get("segments", F.lit(k))))
        nodes = at.filter(here).groupBy("host", "template", "token").agg(
            F.count("*").alias("n"), F.sum("judged").alias("judged"), F.sum("blocked").alias("blocked"), F.sum((F.size("segments") == k + 1).cast("int")).alias("ends")
        )
        labels = materialize(_branches(nodes, least, spread), "url-branches")
        step = F.concat("template", F.lit("/"), F.coalesce("label", F.lit("*")))
        joined = _met(at, labels, ["host", "template", "token"], "path")
        rows = materialize(joined.select("host", "path", "judged", "blocked", "segments", F.when(here, step).otherwise(F.col("template")).alias("template")), "url-paths")
    deeper = F.when(F.size("segments") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return rows.select("host", "path", "judged", "blocked", deeper.alias("template"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    prior: float = PRIOR,
    weight: float = WEIGHT,
    reject: float = REJECT,
    **tree,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row; other columns are not read.

    Null urls and urls without ``://`` have an empty host and path, one template of their own, and are judged like others. Rows that
    repeat an id or a url each get a row. Very long urls and segments are whole. An empty table gives no rows.
    """
    host, path = parts(pages[url_column].cast("string"))
    read = pages.select(pages[id_column].alias("page_id"), host.alias("host"), path.alias("path"))
    read = read.withColumn("fit", fitting_rule(rules, F.col("host"), F.col("path")))
    one = F.coalesce((F.col("fit.verdict") == "block").cast("int"), F.lit(0))
    paths = read.select("host", "path", F.col("fit").isNotNull().cast("int").alias("judged"), one.alias("blocked")).distinct()
    templates = path_templates(paths, **tree)
    known = templates.groupBy("host", "template").agg(F.sum("judged").alias("n_judged"), F.sum("blocked").alias("n_blocked"))
    purity = (F.col("n_blocked") + F.lit(weight) * F.lit(prior)) / (F.col("n_judged") + F.lit(weight))
    known = materialize(known.select("host", "template", purity.alias("purity")), "url-purity")
    of_path = materialize(_met(templates.select("host", "path", "template"), known, ["host", "template"], "path"), "url-verdicts")
    found = _met(read, of_path, ["host", "path"], "page_id")
    learned = F.when(F.col("purity") > reject, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", learned).alias("verdict"), "template", "purity")
