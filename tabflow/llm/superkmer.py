"""Substring dedup: words covered by a 13-word window that also starts in a document with a smaller id are removed.

Consecutive windows that share a minimiser (the smallest hash of a three-word run inside) make a super-k-mer: one packed string that
travels to the bucket of its minimiser, about three times the text in all, instead of thirteen. Equal windows share their minimiser,
so they meet in one bucket, where sorting finds each window's smallest document.

A super-k-mer that several documents of one slice of the input have is sent once, by the smallest of them; the others are marked on
the spot. So a passage that a third of all documents share costs a bucket one string a slice, not one a document.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.shared import documents_of, measured, shards, text_key
from tabflow.llm.words import mix, sequence_hashes, words
from tabflow.session import materialize

WINDOW = 13
MINIMISER = 3
#: Input bytes per bucket (files, so compressed), and text bytes a task looks at together.
BUCKET_BYTES = 3 << 20
SLICE_BYTES = 4 << 20
#: Stands for a null id: larger than any, and no null row is before another.
NO_ID = np.iinfo(np.int64).max
_MARKS, _STRINGS = 0, 1
_FIELDS = (("doc", "<i8"), ("th", "<i8"), ("start", "<i4"), ("windows", "<i2"), ("bytes", "<i4"))


def _packed(fields: dict[str, np.ndarray], strings: bytes) -> bytes:
    n = len(fields["doc"])
    fields = fields | {"doc": np.diff(fields["doc"], prepend=np.int64(0))}  # near each other, so small; wraps around at the ends of the range
    head = b"".join(np.ascontiguousarray(fields[k], t).tobytes() for k, t in _FIELDS)
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", n) + head + strings)


def _unpacked(payload: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,), at, fields = struct.unpack("<q", raw[:8]), 8, {}
    for k, t in _FIELDS:
        size = n * np.dtype(t).itemsize
        fields[k] = np.frombuffer(raw[at : at + size], t)
        at += size
    fields["doc"] = np.cumsum(fields["doc"], dtype=np.int64)
    return fields, raw[at:]


def _ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The bytes of many ranges, one after the other."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return b""
    shift = np.repeat(start - (ends - size), size)
    return data[np.arange(ends[-1]) + shift].tobytes()


def _super_kmers(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with these word hashes: the first and last window of each super-k-mer, its text, and its minimiser."""
    n = np.diff(first)
    window = np.arange(len(hashes))
    row = np.repeat(np.arange(len(n)), n)
    window = window[window + WINDOW <= first[1:][row]]
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    runs = sequence_hashes(hashes, MINIMISER)
    least = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - MINIMISER + 1)[window].argmin(axis=1) + window
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(window)) - 1
    return window[begin], window[last], row[window[begin]], runs[least[begin]]


def _spread(buckets: int):
    """Rows (bucket, kind, payload) of a partition's documents."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
            hashed = batch["th"].to_numpy(zero_copy_only=False)
            for w in words(batch["text"], most=SLICE_BYTES):
                begin, last, row, least = _super_kmers(w.hash, w.first)
                if not len(begin):
                    continue
                whole = sequence_hashes(w.hash, WINDOW)
                # A super-k-mer has at most eleven windows, so its first and last one hold all its words.
                same = mix(whole[begin] ^ mix(whole[last] + (last - begin).astype(np.uint64)))
                doc = ids[w.row + row]
                order = np.lexsort((doc, same))
                head = np.ones(len(order), bool)
                head[1:] = same[order][1:] != same[order][:-1]
                smallest = np.empty(len(order), np.int64)
                smallest[order] = doc[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
                size = w.end[last + WINDOW - 1] - w.start[begin]
                fields = {"doc": doc, "th": hashed[w.row + row], "start": begin - w.first[row], "windows": last - begin + 1, "bytes": size}
                rows: list[tuple[int, int, bytes]] = []
                later = doc > smallest
                if later.any():
                    marks = {k: v[later] for k, v in fields.items()}
                    rows.append((int(least[0] % np.uint64(buckets)), _MARKS, _packed(marks | {"bytes": np.zeros(later.sum(), "<i4")}, b"")))
                sent = np.flatnonzero(~later)
                bucket = (mix(least[sent]) % np.uint64(buckets)).astype(np.int64)
                sent = sent[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for part, b in zip(np.split(sent, cuts), bucket[np.append(0, cuts)].tolist(), strict=True):
                    strings = _ranges(w.data, w.start[begin[part]], size[part])
                    rows.append((b, _STRINGS, _packed({k: v[part] for k, v in fields.items()}, strings)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "payload"])

    return spread


def _runs(doc: np.ndarray, th: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.Table:
    return pa.table({"doc": pa.array(doc, pa.int64()), "th": pa.array(th, pa.int64()), "start": pa.array(start, pa.int32()), "windows": pa.array(windows, pa.int32())})


def _judged(parts: list[tuple[dict[str, np.ndarray], bytes]]) -> pa.Table:
    """The windows of a bucket that also start in a smaller document, as runs."""
    fields = {k: np.concatenate([f[k] for f, _ in parts]) for k, _ in _FIELDS}
    offsets = np.concatenate([[0], np.cumsum(fields["bytes"], dtype=np.int64)])
    data = b"".join(s for _, s in parts)
    strings = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data))
    one, two, of = [], [], []
    for w in words(strings):
        n = np.diff(w.first)
        row = np.repeat(np.arange(w.texts), n)
        window = np.arange(len(w.hash))
        window = window[window + WINDOW <= w.first[1:][row]]
        one.append(sequence_hashes(w.hash, WINDOW)[window])
        two.append(sequence_hashes(w.hash, WINDOW, seed=7)[window])
        of.append(w.row + row[window])
    one, two, of = np.concatenate(one), np.concatenate(two), np.concatenate(of)
    doc = fields["doc"][of]
    order = np.lexsort((doc, two, one))
    head = np.ones(len(order), bool)
    head[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    smallest = np.empty(len(order), np.int64)
    smallest[order] = doc[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
    marked = np.flatnonzero(doc > smallest)
    first = np.concatenate([[0], np.cumsum(fields["windows"], dtype=np.int64)])
    start = fields["start"][of] + (np.arange(len(of)) - first[of])
    new = np.ones(len(marked), bool)
    new[1:] = (marked[1:] != marked[:-1] + 1) | (of[marked][1:] != of[marked][:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(marked)))
    at = marked[begin]
    return _runs(doc[at], fields["th"][of[at]], start[at], size)


def _judge(table: pa.Table) -> pa.Table:
    out, parts = [], []
    for kind, payload in zip(table["kind"].to_pylist(), table["payload"], strict=True):
        fields, strings = _unpacked(payload.as_buffer().to_pybytes())
        if kind == _MARKS:
            out.append(_runs(*(fields[k] for k in ("doc", "th", "start", "windows"))))
        else:
            parts.append((fields, strings))
    if parts:
        out.append(_judged(parts))
    return pa.concat_tables(out)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, th, text. ``th`` tells apart rows that share an id, or have none; where the id is the only one, it is 0 and costs nothing."""
    rows = documents_of(documents)
    again = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("again"))
    again = materialize(again, "repeated-ids")
    own = F.when(F.col("doc_id").isNull() | F.col("again").isNotNull(), text_key(F.col("text"))).otherwise(F.lit(0).cast("long"))
    return rows.join(measured(again), F.col("doc_id") == F.col("again"), "left").select("doc_id", own.alias("th"), "text")


def repeated_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """doc (NO_ID for null), th and runs (start word and number of windows) of every text that has windows to go."""
    spread = rows.mapInArrow(_spread(buckets), "bucket int, kind int, payload binary")
    marks = spread.groupBy("bucket").applyInArrow(_judge, "doc long, th long, start int, windows int")
    return marks.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))


def remove_repeated(documents: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, one blank between) of every row.

    A null text has no words. A null id is larger than any id; windows that only rows with one id share (or only rows without)
    stay. Rows that repeat an id and a text lose the same words. An empty table gives no rows.
    """
    rows = _keyed(documents)
    marks = repeated_windows(rows, shards(documents, bucket_bytes))
    r, m = rows.withColumn("doc", F.coalesce("doc_id", F.lit(int(NO_ID)))).alias("r"), marks.alias("m")
    joined = r.join(m.hint("merge"), ["doc", "th"], "left").select("r.doc_id", "r.text", "m.runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                n_words, n_removed, kept = [], [], []
                runs = part["runs"]
                bounds = runs.offsets.to_numpy()
                start, windows = (runs.values.field(k).to_numpy() for k in ("start", "windows"))
                for k, (text, known) in enumerate(zip(part["text"].to_pylist(), runs.is_valid().to_pylist(), strict=True)):
                    found = (text or "").encode().split()
                    stay = found
                    if known:
                        a, b = bounds[k], bounds[k + 1]
                        edges = np.zeros(len(found) + 1, np.int64)
                        np.add.at(edges, start[a:b], 1)
                        np.add.at(edges, start[a:b] + windows[a:b] + WINDOW - 1, -1)
                        stay = list(itertools.compress(found, (np.cumsum(edges)[:-1] == 0).tolist()))
                    n_words.append(len(found))
                    n_removed.append(len(found) - len(stay))
                    kept.append(b" ".join(stay).decode())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
