"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis), in DataFrame functions only.

Every row gets the exponential key -ln(u) / quality weight, with u from a hash of its id, so reruns agree. In each source the rows
with the smallest keys come first; rows of one key, as of one id or without an id, come in the order of a hash of their texts. A source's target is met by whole epochs of all its rows, then by the rows in key order up to
the rest of the budget. A budget is found without sorting a source: sizes are summed over ranges of keys, and only the keys of the
one range of each source in which the budget ends are sorted; a key in which it ends is cut by its texts in the same way, and of
rows with one key and one text as many are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.shared import measured, text_key
from tabflow.operators.lookup import lookup
from tabflow.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights that the sources take in turn, in the order of their names.
SOURCE_WEIGHTS = (5, 2, 1)
#: Ranges of keys per source; each holds about one in so many of its rows.
RANGES = 4096
HIGH_QUALITY, LOW_QUALITY = 2.0, 0.5


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 52 bits of an MD5; a null id counts as an empty one."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(2.0**52)) / weight


def key_range(key: Column) -> Column:
    return F.floor((1 - F.exp(-key)) * RANGES).cast("int")


def text_range(text: Column) -> Column:
    """RANGES ranges of a text's hash, in its order."""
    return F.shiftright(text, 64 - (RANGES - 1).bit_length()).cast("int")


def weighted(rows: DataFrame, labels: DataFrame | None, key: str) -> DataFrame:
    """``rows`` with the column weight: 2 for quality 1, 1/2 for quality 0, 1 without a label; of several labels the best counts."""
    if labels is None:
        return rows.withColumn("weight", F.lit(1.0))
    best = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") >= 1, HIGH_QUALITY).when(F.col("quality") < 1, LOW_QUALITY).otherwise(1.0)
    found = lookup(rows, F.col(key), measured(materialize(best, "mixing-labels")), "labelled")
    return found.withColumn("weight", weight).drop("labelled", "quality")


def keyed(documents: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, source, size, th (tells texts apart), key of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), text_key(F.col("text").cast("string")).alias("th"))
    return weighted(rows, labels, "doc_id").select("doc_id", "source", "size", "th", sampling_key(F.col("doc_id"), F.col("weight")).alias("key"))


def targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = SOURCE_WEIGHTS) -> DataFrame:
    """source, source_size, target of a table of (source, source_size), one row a source.

    All targets together are ``total_share`` of all sizes; a target stops at ``most`` times its source's size, and the excess goes
    to the other sources by weight until none is above. In closed form: with the sources ordered by cap over weight, the level per
    unit of weight is the largest of those that leave out the caps before it. The windows see one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cap = F.col("source_size") * F.lit(most)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", turn).withColumn("cap", cap).withColumn("budget", F.sum("source_size").over(everything) * F.lit(total_share))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("budget") - before) / left)
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything)).alias("target"))


def _summed(rows: DataFrame, *unit: str) -> DataFrame:
    return rows.groupBy("source", "rest", "before", *unit).agg(F.sum("size").alias("unit_size"), F.count("*").alias("n"))


def _ending(units: DataFrame, order: str) -> DataFrame:
    """Of every source the unit in which its budget ends, and all that comes before it."""
    up_to = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("before", F.col("before") + F.coalesce(F.sum("unit_size").over(up_to), F.lit(0)))
    return units.filter("rest > 0 and before <= rest and before + unit_size > rest")


def _inside(rows: DataFrame, ends: DataFrame, *unit: str) -> DataFrame:
    """The rows of the units in which budgets end."""
    r, e = rows.alias("r"), measured(materialize(ends.select("source", "rest", "before", *unit), "mixing-ends")).alias("e")
    same = F.col("r.source").eqNullSafe(F.col("e.source"))
    for name in unit:
        same = same & (F.col(f"r.{name}") == F.col(f"e.{name}"))
    return r.join(e, same).select("r.*", "e.rest", "e.before")


def mixing_plan(rows: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = SOURCE_WEIGHTS) -> DataFrame:
    """One row a source: source_size, target, epochs, and where the rows that are taken once more end: cut_range, cut_key and cut_text; of the cut_rows rows there, cut_taken.

    ``rows`` are those of ``keyed``. A row at the end of the budget is taken if half of it or more fits, so a source misses its
    target by half a row at most. Sources without words have target 0 and take every row no time.
    """
    sums = materialize(rows.groupBy("source", key_range(F.col("key")).alias("range")).agg(F.sum("size").alias("range_size")), "mixing-ranges")
    plan = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), total_share, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan, "mixing-targets")
    p, s = plan.alias("p"), sums.alias("s")
    ranges = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select("p.source", "p.rest", F.lit(0).cast("long").alias("before"), "s.range", F.col("s.range_size").alias("unit_size"))
    placed = rows.select("source", "size", "key", "th", key_range(F.col("key")).alias("range"), text_range(F.col("th")).alias("text_range"))
    last = materialize(_inside(placed, _ending(ranges, "range"), "range"), "mixing-last")
    known = last.drop("rest", "before")
    last = _inside(known, _ending(_summed(last, "range", "key"), "key"), "key")
    last = _inside(known, _ending(_summed(last, "key", "text_range"), "text_range"), "key", "text_range")
    cuts = _ending(_summed(last, "range", "key", "th"), "th")
    # Row j (from 0) of the equal ones is taken if before + j size + size / 2 <= rest.
    size, left = F.col("unit_size") / F.col("n"), F.col("rest") - F.col("before")
    fit = F.floor(left / size + F.lit(0.5))
    fit = F.when((fit - 1) * size + size / 2 > left, fit - 1).otherwise(fit)
    c = cuts.withColumn("taken", F.least(F.col("n"), fit)).alias("c")
    out = p.join(c, F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    cut = [F.col(f"c.{a}").alias(f"cut_{b}") for a, b in (("range", "range"), ("key", "key"), ("th", "text"), ("taken", "taken"), ("n", "rows"))]
    return materialize(out.select("p.source", "p.source_size", "p.target", "p.epochs", *cut), "mixing-plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (row, source, key, th) with the plan's columns, and copies: how often a row is taken, once an epoch, and once more up to the cut.

    Without a cut nothing is left over. Where a cut leaves some of several rows with one key and one text, these are numbered in the
    order in which they are read.
    """
    r, p = rows.alias("r"), measured(plan).alias("p")
    joined = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", *[F.col(f"p.{n}") for n in plan.columns if n != "source"])
    bucket = key_range(F.col("key"))
    at_key = (bucket == F.col("cut_range")) & (F.col("key") == F.col("cut_key"))
    at_cut = F.coalesce(at_key & (F.col("th") == F.col("cut_text")), F.lit(False))
    before = (bucket < F.col("cut_range")) | ((bucket == F.col("cut_range")) & (F.col("key") < F.col("cut_key"))) | (at_key & (F.col("th") < F.col("cut_text")))
    split = F.col("cut_taken").between(F.lit(1), F.col("cut_rows") - 1)
    more = F.coalesce(before, F.lit(False)) | (at_cut & (F.col("cut_taken") == F.col("cut_rows")))
    copies = lambda more: (F.col("epochs") + F.when(more, 1).otherwise(0)).cast("long")
    if plan.filter(split).isEmpty():
        return joined.withColumn("copies", copies(more))
    equal = joined.filter(at_cut & split).withColumn("number", F.monotonically_increasing_id())
    equal = materialize(equal.withColumn("part", F.shiftright("number", 33)), "mixing-equal")
    counts = equal.groupBy("source", "part").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    e, c = equal.alias("e"), measured(materialize(counts, "mixing-parts")).alias("c")
    equal = e.join(c, F.col("e.source").eqNullSafe(F.col("c.source")) & (F.col("e.part") == F.col("c.part"))).select("e.*", "c.earlier")
    place = F.col("earlier") + F.row_number().over(Window.partitionBy("source", "part").orderBy("number"))
    equal = equal.withColumn("copies", copies(place <= F.col("cut_taken"))).drop("number", "part", "earlier")
    return joined.filter(~(at_cut & F.coalesce(split, F.lit(False)))).withColumn("copies", copies(more)).unionByName(equal)


def mix(documents: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix takes the row) of every row.

    Null texts have size 0; null sources are one source, the last; repeated rows are rows of their own: they share their key, and each has a place of its own.
    An empty table gives no rows.
    """
    rows = materialize(keyed(documents, labels), "mixing-keys")
    return with_copies(rows, mixing_plan(rows, **options)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_documents(documents: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, with all their columns."""
    plan = mixing_plan(materialize(keyed(documents, labels), "mixing-keys"), **options)
    text = text_key(F.col("text").cast("string")).alias("th")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), text)
    rows = weighted(rows, labels, "id").select("row", "source", "th", sampling_key(F.col("id"), F.col("weight")).alias("key"))
    each = with_copies(rows, plan).filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.select(*[F.col("row").getField(n).alias(n) for n in documents.columns])
