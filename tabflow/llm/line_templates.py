"""Line dedup by a tree of log templates of fixed depth: lines whose template recurs across documents are dropped.

The tree has the number of tokens on its first level and one leading token on each further one; tokens with digits count as
variable there. A line has up to three templates:

- the whole line, its tokens with digits masked (unmasked where too few places would be left). It recurs from ``least_whole`` different
  texts on, two by default, at any length and in any leaf;
- the line with the tokens that are usual in its leaf: those that ``least`` different texts and ``leaf_share`` of the leaf's texts have at
  their place; the other places are variable fields;
- the same with the tokens that ``least`` different texts have at their place, however many other texts reach the leaf.

The latter two recur if ``least`` different texts have them, at least ``constant`` of their places being fixed; they need
``least_tokens`` tokens. A line goes if one of its templates recurs and has an earlier line (smallest doc_id). Copies of one whole text
count as one text, so a copied document does not make its own lines recur. Blank lines stay.

No step gathers a leaf: counts combine in the map tasks, and only lines in leaves that recur are cut into places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.shared import documents_of, measured, text_key
from tabflow.session import materialize

BLANKS = "\t\x0b\x0c\r"
VARIABLE = "<*>"
DEPTH = 3
LEAST_TEXTS = 8
LEAST_WHOLE = 2
LEAST_TOKENS = 4
LEAF_SHARE = 0.1
CONSTANT = 0.6


def _tokens(line: Column) -> Column:
    """Split at single blanks, which needs no pattern matching."""
    return F.filter(F.split(F.translate(line, BLANKS, " " * len(BLANKS)), " "), lambda t: t != "")


def _masked(tokens: Column) -> Column:
    """Tokens with a digit are variable fields from the start."""
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), VARIABLE).otherwise(t))


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, th (tells texts apart), line (its place), tokens, masked, of every line that is not blank."""
    # Cut inside the generator, so that its output is a column and the cutting is done once; most lines have no digit to look for.
    tokens = lambda l: F.struct(_tokens(l).alias("tokens"), l.rlike("[0-9]").alias("digits"))
    cut = F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), tokens)).alias("line", "cut")
    rows = documents_of(documents).select("doc_id", text_key(F.col("text")).alias("th"), cut)
    masked = F.when(F.col("cut.digits"), _masked(F.col("cut.tokens"))).otherwise(F.col("cut.tokens"))
    return rows.select("doc_id", "th", "line", F.col("cut.tokens").alias("tokens"), masked.alias("masked")).filter(F.size("tokens") > 0)


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th", "line")


def _recurring(templates: DataFrame, least: int) -> DataFrame:
    """doc_id, th, line of all lines but the first of each template that ``least`` different texts have."""
    texts = templates.groupBy("template", "th").agg(F.min(_first()).alias("first")).groupBy("template").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    known = measured(materialize(texts.filter(F.col("texts") >= least).select("template", "first"), "line-recurring"))
    return templates.join(known, "template").filter(~F.col("first").eqNullSafe(_first())).select("doc_id", "th", "line")


def _leaf(least_tokens: int) -> Column:
    """The leaf of a line with enough tokens, else null."""
    return F.when(F.size("masked") >= least_tokens, F.xxhash64(F.size("masked"), F.slice("masked", 1, DEPTH))).alias("leaf")


def _usual_templates(every: DataFrame, held: DataFrame, least: int, least_tokens: int, leaf_share: float, constant: float) -> DataFrame:
    """template, doc_id, th, line of the lines with enough usual tokens, by either rule of what is usual. ``held`` has leaf and th of all lines."""
    every = every.filter(F.size("masked") >= least_tokens).withColumn("leaf", _leaf(least_tokens))
    leaves = held.filter(F.col("leaf").isNotNull()).groupBy("leaf", "th").agg(F.lit(1)).groupBy("leaf").agg(F.count("*").alias("texts")).filter(F.col("texts") >= least)
    leaves = measured(materialize(leaves, "line-leaves"))
    rows = materialize(every.join(leaves, "leaf").select("leaf", "texts", "doc_id", "th", "line", "masked"), "line-tokens")

    places = rows.select("leaf", "texts", "th", F.posexplode("masked").alias("place", "token"))
    counts = places.groupBy("leaf", "texts", "place", "token", "th").agg(F.lit(1)).groupBy("leaf", "texts", "place", "token").agg(F.count("*").alias("n"))
    usual = F.col("n") >= F.lit(leaf_share) * F.col("texts")
    fixed = counts.filter((F.col("n") >= least) & (F.col("token") != VARIABLE)).select("leaf", "place", "token", F.lit(True).alias("fixed"), usual.alias("usual"))
    fixed = measured(materialize(fixed, "line-places"))

    one = rows.select("leaf", "doc_id", "th", "line", F.posexplode("masked").alias("place", "token")).join(fixed, ["leaf", "place", "token"], "left")
    token = lambda rule: F.when(F.col(rule), F.col("token")).otherwise(VARIABLE).alias(rule)
    parsed = one.groupBy("leaf", "doc_id", "th", "line").agg(
        F.array_sort(F.collect_list(F.struct("place", token("fixed"), token("usual")))).alias("kept"), F.count("fixed").alias("n_fixed"), F.count_if("usual").alias("n_usual"), F.count("*").alias("n")
    )
    by = lambda rule, n: F.when(F.col(n) >= F.lit(constant) * F.col("n"), F.xxhash64("leaf", F.col(f"kept.{rule}")))
    parsed = parsed.withColumn("template", F.explode(F.array_distinct(F.array(by("fixed", "n_fixed"), by("usual", "n_usual")))))
    return parsed.filter(F.col("template").isNotNull()).select("template", "doc_id", "th", "line")


def recurring_lines(
    documents: DataFrame, least: int = LEAST_TEXTS, least_tokens: int = LEAST_TOKENS, leaf_share: float = LEAF_SHARE, constant: float = CONSTANT, least_whole: int = LEAST_WHOLE
) -> DataFrame:
    """doc_id, th, drop: the places of the lines that go, one row for each text that loses any."""
    every = lines(documents)
    plain = F.size(F.filter("masked", lambda t: t != VARIABLE)) >= F.lit(constant) * F.size("masked")
    whole = every.select(F.xxhash64(F.when(plain, F.col("masked")).otherwise(F.col("tokens"))).alias("template"), "doc_id", "th", "line", _leaf(least_tokens))
    whole = materialize(whole, "line-wholes")  # with the leaves, so that texts are cut into lines twice, not three times
    usual = materialize(_usual_templates(every, whole, least, least_tokens, leaf_share, constant), "line-templates")
    whole = whole.drop("leaf")
    gone = _recurring(whole, least_whole).union(_recurring(usual, least))
    return materialize(gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("drop")), "line-drops")


def _cut(documents: DataFrame, **options) -> DataFrame:
    """row (all columns), written (its lines) and drop (the places of those that go)."""
    drops = recurring_lines(documents, **options).hint("merge")  # one form at every size
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text").cast("string")).alias("of"))
    r, d = rows.alias("r"), drops.alias("d")
    joined = r.join(d, F.col("r.id").eqNullSafe(F.col("d.doc_id")) & (F.col("r.of") == F.col("d.th")), "left")
    written = F.split(F.col("row").getField("text").cast("string"), "\n", -1)
    return joined.select("row", written.alias("written"), F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))


def _left() -> Column:
    kept = F.array_join(F.filter("written", lambda x, i: ~F.array_contains(F.col("drop"), i)), "\n")
    return F.when(F.size("drop") == 0, F.col("row").getField("text")).otherwise(kept)


def drop_lines(documents: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, the text without the lines that go.

    Null texts stay null and have no lines (an empty text has one, empty); a row whose lines all go keeps an empty text. Rows that
    repeat an id and a text lose the same lines. An empty table gives no rows.
    """
    columns = [_left().alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in documents.columns]
    return _cut(documents, **options).select(*columns)


def line_report(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, of every row."""
    doc_id, n_lines = F.col("row").getField("doc_id"), F.when(F.col("written").isNull(), 0).otherwise(F.size("written"))
    return _cut(documents, **options).select(doc_id.alias("doc_id"), n_lines.cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"), _left().alias("text"))
