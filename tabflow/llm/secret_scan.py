"""Secrets in texts, in DataFrame functions only: three fixed patterns, and a battery of randomness tests on long tokens.

The battery takes every token of 20 or more characters of an encoding's alphabet, infers the encoding, and tests against uniformly
random characters: chi-squared on the counts of the alphabet, runs of character classes, and serial correlation of neighbours.
The three p-values are combined (Fisher). Tokens that are not random (words, names, paths) have tiny p-values. In each stratum of
encoding and length, Benjamini and Hochberg's rule finds those for which chance is ruled out at a false-discovery rate of 1 %;
what is left is reported as a secret. So a random token is lost at most about once in a hundred, at any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.session import materialize

# Fixed values of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: name, pattern of the body, alphabet, and the shares of lower-case letters, upper-case letters, digits and other characters.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", (6, 0, 10, 0)),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF", (0, 6, 10, 0)),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (0, 26, 6, 0)),
    ("BASE36", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", (0, 26, 10, 0)),
    ("base36", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", (26, 0, 10, 0)),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (26, 26, 10, 0)),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (26, 26, 10, 2)),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", (26, 26, 10, 2)),
)
LENGTHS = (24, 32, 48, 64, 128)
RATE = 0.01
#: p-values are counted on a grid of tenths of a decimal power, down to 10**-30.
GRID, DEEPEST = 10, 30
_MARK, _OTHER = "\x01", "\x02"


def upper_normal(z: Column) -> Column:
    """P(Z > z) for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + F.lit(0.2316419) * z)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi)) * poly


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_normal(F.abs(z)))


def chi_squared_tail(x: Column, df: int) -> Column:
    """P(X > x) by Wilson and Hilferty's cube root."""
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return F.when(z >= 0, upper_normal(z)).otherwise(1 - upper_normal(-z))


def _floor(p: Column) -> Column:
    return F.greatest(p, F.lit(1e-300))


def _battery(body: Column, alphabet: str, shares: tuple[int, ...]) -> Column:
    """The combined p-value of a token of this alphabet."""
    m, n = len(alphabet), F.length(body).cast("double")
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)))
    uniform = chi_squared_tail(squares * m / n - n, m - 1)

    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[a-z]", "à"), "[A-Z]", "À"), "[0-9]", "0"), "[+/_-]", "-"), "àÀ", "aA")
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(classes, "a+", "a"), "A+", "A"), "0+", "0"), "-+", "-")
    change = 1 - sum((s / m) ** 2 for s in shares)
    runs = two_sided((F.length(kept) - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change)))

    places = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    total = F.aggregate(places, F.lit(0.0), lambda a, x: a + x)
    return F.struct(uniform.alias("uniform"), runs.alias("runs"), places.alias("places"), (total / n).alias("mean"), n.alias("n"))


def _combined(b: Column) -> Column:
    spread = F.aggregate(b["places"], F.lit(0.0), lambda a, x: a + (x - b["mean"]) * (x - b["mean"]))
    size = b["n"].cast("int")
    pairs = F.zip_with(F.slice(b["places"], F.lit(1), size - 1), F.slice(b["places"], F.lit(2), size - 1), lambda x, y: (x - b["mean"]) * (y - b["mean"]))
    lag = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    z = (F.when(spread > 0, lag / spread).otherwise(1.0) + 1 / b["n"]) * F.sqrt(b["n"])
    half = -(F.log(_floor(b["uniform"])) + F.log(_floor(b["runs"])) + F.log(_floor(two_sided(z))))
    return F.exp(-half) * (1 + half + half * half / 2)


def _pieces(text: Column) -> Column:
    """Per kind, the text cut so that its matches are the pieces at odd places."""
    cut = [F.split(F.regexp_replace(text, f"({p})", f"{_MARK}$1{_MARK}"), _MARK, -1) for p in (ASSIGN, ACCESS, HEX, CANDIDATE)]
    rows = [F.struct(F.lit(k).alias("kind"), c.alias("pieces")) for k, c in enumerate(cut)]
    here = F.struct(F.lit(-1).alias("kind"), F.array(F.lit("")).alias("pieces"))
    return F.array(here, *rows)


def found(documents: DataFrame) -> DataFrame:
    """The pieces of every text around its matches: row, doc_id, kind, place, size, and of a match whether it holds, encoding, length and p.

    Every document has a piece of kind -1. ``row`` tells rows of the input apart, repeated ones too.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, _OTHER)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("row", "doc_id", F.explode(_pieces(F.col("text"))).alias("of"))
    rows = rows.filter("of.kind = -1 or size(of.pieces) > 1").select("row", "doc_id", "of.kind", F.posexplode("of.pieces").alias("place", "piece"))
    match = F.col("place") % 2 == 1
    body = F.regexp_replace("piece", "=+$", "")
    candidate = match & (F.col("kind") == 3)
    encoding = F.coalesce(*[F.when(body.rlike(p), F.lit(k)) for k, (_, p, _, _) in enumerate(ENCODINGS)])
    rows = rows.select("row", "doc_id", "kind", "place", F.length("piece").alias("size"), F.when(match, F.col("piece")).alias("piece"), F.when(candidate, encoding).alias("encoding"), F.when(candidate, body).alias("body"))
    tests = None
    for k, (_, _, alphabet, shares) in enumerate(ENCODINGS):
        hit = F.col("encoding") == k
        tests = F.when(hit, _battery(F.col("body"), alphabet, shares)) if tests is None else tests.when(hit, _battery(F.col("body"), alphabet, shares))
    rows = rows.withColumn("tests", tests)
    length = sum((F.when(F.length("body") >= least, 1).otherwise(0) for least in LENGTHS), F.lit(0))
    holds = F.when(F.col("kind") == 0, F.length(F.regexp_extract("piece", ASSIGN, 1)) >= ASSIGN_LEAST).otherwise(True)
    p = F.when(F.col("encoding").isNotNull(), _combined(F.col("tests")))
    return rows.select("row", "doc_id", "kind", "place", "size", F.when(F.col("piece").isNotNull(), holds).alias("holds"), "encoding", F.when(F.col("encoding").isNotNull(), length).alias("length"), p.alias("p"))


def thresholds(rows: DataFrame, rate: float = RATE) -> DataFrame:
    """Per stratum, the grid place from which on chance is ruled out (Benjamini and Hochberg). At most encodings x lengths rows of 300 places."""
    grid = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) * GRID), F.lit(GRID * DEEPEST)).cast("int")
    counts = rows.filter("p is not null").groupBy("encoding", "length", grid.alias("grid")).agg(F.count("*").alias("n"))
    stratum = Window.partitionBy("encoding", "length")
    below = F.sum("n").over(stratum.orderBy(F.desc("grid")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("rank", below).withColumn("all", F.sum("n").over(stratum))
    largest = F.pow(F.lit(10.0), -F.col("grid") / GRID)
    return counts.filter(largest <= F.lit(rate) * F.col("rank") / F.col("all")).groupBy("encoding", "length").agg(F.min("grid").alias("ruled_out"))


def scan(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id and spans of every row: an array of (start, order, kind, end) in order, in code points, the end exclusive.

    A null text is an empty one and has no spans; repeated rows are each scanned. Random tokens inside a span of the patterns are
    not listed again. Equal rows and rows without an id are kept apart by their place in the input.
    """
    rows = materialize(found(documents), "secret-pieces")
    limits = F.broadcast(thresholds(rows, rate))
    grid = F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) * GRID)
    rows = rows.join(limits, ["encoding", "length"], "left")
    within = Window.partitionBy("row", "doc_id", "kind").orderBy("place")
    end = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("end", end)
    random = F.col("encoding").isNotNull() & (F.coalesce(F.col("ruled_out"), F.lit(GRID * DEEPEST + 1)) > grid)
    kept = F.when(F.col("kind") == 3, random).otherwise(F.col("holds"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.when(kept, F.struct((F.col("end") - F.col("size")).alias("start"), F.col("kind").alias("order"), name.alias("kind"), F.col("end").alias("end")))
    docs = rows.withColumn("span", F.when(F.col("kind") >= 0, span)).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    base = F.filter("spans", lambda s: s["order"] < 3)
    added = F.filter("spans", lambda s: (s["order"] == 3) & ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return docs.select("doc_id", F.array_sort(F.concat(base, added)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
