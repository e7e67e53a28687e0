"""I-Match fingerprints: the terms of a text in a band of document frequency, hashed under several random lexicons.

The lexicon is what occurs in at least ``LEAST`` and at most ``MOST`` of all different texts, so copies of a text do not push its terms
out. It is exact: a term that reaches the share in
the corpus reaches it in some partition, so each partition names its own candidates, and then only the candidates are counted.
Every random lexicon keeps another part of the terms: ``EACH`` lexicons each of a half, a quarter, ... of them. A slot of the
fingerprint is the hash of a text's distinct terms in one of them. Sparse lexicons survive edits of long texts, dense ones tell
short texts apart. A text that no lexicon meets has slots from all its own terms, the rarer and the commoner ones; it is compared on
that footing with any text. Likeness is the share of equal slots among those that either text fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.shared import documents_of, measured, shards, text_key
from tabflow.llm.words import mix, words
from tabflow.session import materialize

LEAST, MOST = 0.002, 0.1
LEVELS, EACH = 12, 5
SLOTS = LEVELS * EACH
DIGITS = 6
SHARD_BYTES = 16 << 20
EMPTY = "-" * DIGITS


def _distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term once a text, sorted by text and term."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], row[new]


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, texts, terms, text of each) of runs of texts."""
    for w in words(column, lower=True):
        yield w.row, w.texts, *_distinct(w.hash, np.repeat(np.arange(w.texts), np.diff(w.first)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    found, place = np.unique(terms, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def _counter(wanted: np.ndarray | None, least: float):
    """Document counts of a partition: of the wanted terms, or of those that reach the share ``least`` in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, documents = [], 0, 0
        for batch in batches:
            documents += len(batch)
            for _, _, terms, _ in _terms(batch["text"]):
                if wanted is not None:
                    terms = terms[np.isin(terms, wanted)]
                parts.append(np.unique(terms, return_counts=True))
                held += len(parts[-1][0])
                if held > 4_000_000 and len(parts) > 1:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
        if parts:
            terms, counts = _merged(parts)
            kept = counts >= (1 if wanted is not None else least * documents)
            yield pa.RecordBatch.from_arrays([pa.array(terms[kept].view(np.int64)), pa.array(counts[kept])], ["term", "n"])

    return count


def lexicon(documents: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """The sorted hashes of all terms whose share of documents is in the band; every row counts.

    No more than (mean number of distinct terms) / ``least`` terms reach the share, however many documents there are; that bounds
    what is sent to the tasks.
    """
    texts = documents.select(F.col("text").cast("string").alias("text"))
    named = texts.mapInArrow(_counter(None, least), "term long, n long").select("term").distinct().toPandas()["term"]
    wanted = np.sort(named.to_numpy(np.int64).view(np.uint64))
    counted = texts.mapInArrow(_counter(wanted, least), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    everything = texts.count()
    band = counted.filter((F.col("n") >= least * everything) & (F.col("n") <= most * everything)).toPandas()["term"]
    return np.sort(band.to_numpy(np.int64).view(np.uint64))


def distinct_texts(documents: DataFrame) -> DataFrame:
    """Every text once. Only texts that repeat are gathered, each once a map task; the others stay where they are."""
    docs = documents_of(documents).select("text", text_key(F.col("text")).alias("th"))
    repeated = measured(materialize(docs.groupBy("th").count().filter("count > 1").select("th"), "imatch-repeated"))
    copied = docs.join(repeated, "th", "left_semi").dropDuplicates(["th"]).select("text")
    return docs.join(repeated, "th", "left_anti").select("text").unionByName(materialize(copied, "imatch-copied"))


def _slots(texts: list[str], band: np.ndarray | None) -> np.ndarray:
    """The slots of each text as numbers (0: empty), from its terms in the band, or from all."""
    slots = np.zeros((len(texts), SLOTS), np.int64)
    for first, n, terms, row in _terms(pa.array(texts, pa.large_string())):
        if band is not None:
            inside = np.isin(terms, band) if len(band) else np.zeros(len(terms), bool)
            terms, row = terms[inside], row[inside]
        for j in range(SLOTS):
            drawn = mix(terms + np.uint64(j))
            kept = drawn >> np.uint64(64 - 1 - j // EACH) == 0
            if kept.any():
                total = np.zeros(n, np.uint64)
                np.add.at(total, row[kept], mix(drawn[kept]))
                full = np.zeros(n, bool)
                full[row[kept]] = True
                slots[first : first + n, j][full] = (mix(total[full]) % np.uint64(16**DIGITS - 1)).astype(np.int64) + 1
    return slots


def fingerprints(texts: list[str], band: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A string for each text, its slots, and whether these come from all its terms, as the band fills none. A text that fills none even so (as one without terms) has a digest of itself in place of the slots."""
    slots = _slots(texts, band)
    bare = ~slots.any(axis=1)
    if bare.any():
        slots[bare] = _slots([texts[i] for i in np.flatnonzero(bare)], None)
    names = []
    for text, own in zip(texts, slots.tolist(), strict=True):
        names.append("".join(f"{s:0{DIGITS}x}" if s else EMPTY for s in own) if any(own) else hashlib.md5(text.encode()).hexdigest())
    return names, slots, bare


def nearness(texts: tuple[list[str], list[str]], names: tuple[list[str], list[str]], slots: tuple[np.ndarray, np.ndarray], bare: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Likeness of pairs of texts; if the band fills slots of one of them only, by all terms of both."""
    one, two = slots
    uneven = np.flatnonzero(bare[0] != bare[1])
    if len(uneven):
        one, two = one.copy(), two.copy()
        one[uneven], two[uneven] = (_slots([t[i] for i in uneven], None) for t in texts)
    return likeness(one, two, np.array([a == b for a, b in zip(*names, strict=True)], bool))


def likeness(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of two arrays of slots, row by row; ``equal`` says which fingerprints are the same."""
    either = (a != 0) | (b != 0)
    same = ((a == b) & either).sum(axis=1)
    return np.where(equal, 1.0, same / np.maximum(1, either.sum(axis=1)))


def in_order(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """bucket, edge, doc_id, text: partitions sorted by ascending doc_id, each bucket closed by a copy of the row that follows it (edge).

    After the last row comes the first. Null ids come first, in the order of a hash of their texts, as do rows with one id; so even a
    third of all rows with one null id is dealt over buckets. Texts are shuffled once.
    """
    docs = documents_of(documents).withColumn("th", text_key(F.col("text")))
    n = shards(documents, shard_bytes)
    shares = [i / n for i in range(1, n)]
    cuts = documents_of(documents).agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)) if shares else F.lit(0.5), 10_000).alias("cuts")).first()["cuts"]
    cuts = np.array(cuts if isinstance(cuts, list) else [], np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        known = np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), "right") + n
        spread = ((hashes.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64) * n >> 32
        return pd.Series(np.where(ids.isna(), spread, known).astype(np.int32))

    docs = docs.withColumn("bucket", place("doc_id", "th"))
    firsts = docs.groupBy("bucket").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(everything))
    firsts = materialize(firsts.select(to.alias("bucket"), F.col("first.doc_id").alias("id"), F.col("first.th").alias("of")), "first-rows")
    follow = docs.drop("bucket").join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("of")))
    columns = ["bucket", "edge", "doc_id", "th", "text"]
    both = docs.withColumn("edge", F.lit(False)).select(columns).unionByName(follow.withColumn("edge", F.lit(True)).select(columns))
    return both.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "edge", "doc_id", "th", "text").drop("th")


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many of the following text's first (or all of them)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(documents: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is an empty one. Of one row alone, the next is itself; an empty table gives no rows.
    """
    band = lexicon(distinct_texts(documents), least, most)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        texts = [t or "" for _, _, t in rows]
        names, slots, bare = fingerprints(texts, band)
        here = [i for i in range(len(rows) - 1) if not rows[i][0]]
        after = [edited(texts[i], texts[i + 1]) for i in here]
        new_names, new_slots, new_bare = fingerprints(after, band)
        following = [i + 1 for i in here]
        pick = lambda values, places: [values[i] for i in places]
        own, own_names = pick(texts, here), pick(names, here)
        near_edited = nearness((own, after), (own_names, new_names), (slots[here], new_slots), (bare[here], new_bare))
        near_next = nearness((own, pick(texts, following)), (own_names, pick(names, following)), (slots[here], slots[following]), (bare[here], bare[following]))
        columns = [
            pa.array([rows[i][1] for i in here], pa.int64()),
            pa.array([len(texts[i]) for i in here], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in after], pa.string()),
            pa.array(own_names, pa.string()),
            pa.array(new_names, pa.string()),
            pa.array(near_edited, pa.float64()),
            pa.array(near_next, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                rows += zip(part["edge"].to_pylist(), part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)
                if len(rows) > 1:
                    yield told(rows)
                rows = rows[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(documents).select("edge", "doc_id", "text").mapInArrow(follow, schema)
