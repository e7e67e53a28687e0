"""Language of a text by bit-sliced Bloom filters over letter n-grams.

One table of slots holds the Bloom filters of all languages, a bit of a slot for each language. An n-gram has a few slots; the AND
of their words is the mask of all languages that contain it, found in one pass. A text's hits are counted per language by bit and
corrected for the filter's false positives: of n n-grams, about n * f hits come by chance where f is the share of n-grams outside the
language that its filter lets through. The language with most corrected hits wins.

A language contains the n-grams that make up at least ``LEAST_SHARE`` of its sampled n-grams and are not much more frequent elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.words import mix

UNKNOWN = "und"
N = 3
#: Slots of the table (a power of two), and slots an n-gram takes.
SLOTS, HASHES = 1 << 18, 3
#: The filters are fitted on at most so many labelled texts a language, those whose hashed ids come first.
SAMPLE = 1000
LEAST_SHARE = 1e-5
#: An n-gram belongs to a language if its share there is at least this part of its largest share in any language.
NEAR_LARGEST = 0.2
_SLICE_CHARS = 1 << 19


class Filters(NamedTuple):
    languages: list[str]
    slots: np.ndarray  #: SLOTS x words of 64 languages
    passed: np.ndarray  #: false-positive share of each language's filter


def _letters() -> np.ndarray:
    kept = _letters.__dict__
    if "table" not in kept:
        kept["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return kept["table"]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, in lower case, every run of other characters one blank; and the text each belongs to."""
    letters = _letters()
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    alpha = letters[codes]
    codes = np.where(alpha, codes, 32).astype(np.uint64)
    keep = alpha | np.concatenate([[True], alpha[:-1] | (row[1:] != row[:-1])]) if len(codes) else alpha
    codes, row = codes[keep], row[keep]
    total = np.zeros(max(0, len(codes) - N + 1), np.uint64)
    for j in range(N):
        total = (total << np.uint64(21)) | codes[j : j + len(total)]
    inside = row[: len(total)] == row[N - 1 :] if len(total) else np.zeros(0, bool)
    middle = inside & (codes[1 : 1 + len(total)] != 32) if len(total) else inside
    return mix(total[middle]), row[: len(total)][middle]


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    return [(mix(hashes + np.uint64(k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters of all labels, from at most ``sample`` texts a label. Held-out rows, null ids, labels and texts are not learned from.

    The sample is drawn before anything is shuffled: each task keeps the first ``sample`` rows of a label.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("lang", "doc_id").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample)
    picked = rows.join(F.broadcast(ids.select("lang", "doc_id").distinct()), ["lang", "doc_id"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for lang, texts in frame.groupby("lang")["text"]:
                texts = texts.tolist()
                for at in range(0, len(texts), 100):
                    found, n = np.unique(_grams(texts[at : at + 100])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = picked.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    largest = F.max("share").over(Window.partitionBy("gram"))
    own = counts.withColumn("share", share).filter(F.col("share") >= LEAST_SHARE).withColumn("largest", largest).filter(F.col("share") >= NEAR_LARGEST * F.col("largest"))
    return _filled(own.select("lang", "gram").toPandas())


def _filled(own: pd.DataFrame) -> Filters:
    """At most 1 / LEAST_SHARE n-grams a language come to the driver, whatever the sample."""
    languages = sorted(own["lang"].unique().tolist())
    slots = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
    for k, lang in enumerate(languages):
        for place in _places(own.loc[own["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)):
            slots[place, k // 64] |= np.uint64(1) << np.uint64(k % 64)
    filled = [np.count_nonzero(slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) / SLOTS for k in range(len(languages))]
    return Filters(languages, slots, np.array(filled) ** HASHES)


def predictor(filters: Filters):
    """A function of a text column: struct of lang_pred and score.

    ``und`` with score 0 for texts that are null or have no letter, and for all texts if nothing was learned. The score is the
    winner's share of all corrected hits; without any hit the first language is named, with score 0.
    """
    languages, slots, passed = filters

    def judge(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes, row = _grams(texts)
        masks = slots[_places(hashes)[0]].copy() if len(hashes) else np.zeros((0, slots.shape[1]), np.uint64)
        for place in _places(hashes)[1:]:
            masks &= slots[place]
        n = np.bincount(row, minlength=len(texts)).astype(float)
        hits = np.stack([np.bincount(row, (masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(float), len(texts)) for k in range(len(languages))], axis=1)
        hits = np.maximum(0, (hits - n[:, None] * passed) / (1 - passed))
        best, total = hits.argmax(axis=1), hits.sum(axis=1)
        return best, np.where(total > 0, hits.max(axis=1) / np.maximum(total, 1e-300), 0.0)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if languages and any(c.isalpha() for c in t)]
        while known:
            taken, size = 0, 0
            while taken < len(known) and (taken == 0 or size + len(texts[known[taken]]) <= _SLICE_CHARS):
                size += len(texts[known[taken]])
                taken += 1
            head, known = known[:taken], known[taken:]
            best, score = judge([texts[i] for i in head])
            for i, b, s in zip(head, best.tolist(), score.tolist(), strict=True):
                names[i], scores[i] = languages[b], s
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def predict_languages(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; repeated rows each give one."""
    rows = documents.select(F.col("doc_id"), predictor(filters)(F.col("text").cast("string")).alias("found"))
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


def with_language(documents: DataFrame, filters: Filters) -> DataFrame:
    """Only the rows whose language could be told, all columns unchanged: texts without letters, or in no learned letter sequence, go."""
    found = predictor(filters)(F.col("row").getField("text").cast("string"))
    rows = documents.select(F.struct("*").alias("row")).withColumn("found", found).filter((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") > 0))
    return rows.select(*[F.col("row").getField(n).alias(n) for n in documents.columns])
