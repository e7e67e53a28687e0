"""Alignment of two tokenizers' tokens by their bytes, and how many documents hold each linked pair of ids.

A merge of the byte offsets where A's and B's tokens end gives everything: each different end is one link, between the two tokens that
cover the byte before it, and an end of both closes a group. The merge is cut by merge path: a binary search along each diagonal of the
two lists finds where ``work`` ends have been merged, so pieces of equal work need nothing of each other but the token that follows on
either side. Documents are merged side by side, up to ``work`` ends at a time; a longer document is cut into pieces, which are shuffled
to other tasks, and the groups that cross their bounds are stitched.

Documents stay in slices, one row each: what the corpus says of a pair is looked up once a slice, not once a document.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.shared import documents_of
from tabflow.llm.tokens import Encoder
from tabflow.session import materialize

#: Ends merged at a time.
WORK = 1 << 18
#: Different (document, pair) entries of a slice; a longer document is a slice of its own.
SLICE_PAIRS = 3_000_000
CACHED_WORDS = 400_000
_SHIFT = 32
_ROW = pa.schema(
    [
        ("slice", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),  # n_a, n_b, n_groups, n_links, different pairs of each document
        ("digests", pa.list_(pa.string())),
        ("pairs", pa.list_(pa.int64())),  # different pairs of the slice, A id above the low 32 bits
        ("held_by", pa.list_(pa.int32())),  # documents of the slice that hold each
        ("entries", pa.binary()),  # packed: place in pairs, links, of each document's pairs
        ("piece", pa.int32()),  # of a document that is cut; the columns above but its id are empty then
        ("own", pa.list_(pa.int32())),  # tokens of A, of B, that end in the piece
        ("start", pa.list_(pa.int64())),  # byte where the first token of A, of B, begins
        ("size", pa.list_(pa.int64())),  # tokens of A, of B, of the document
        ("a", pa.binary()),
        ("b", pa.binary()),
    ]
)
_ROW_SQL = "slice long, doc_ids array<long>, counts array<long>, digests array<string>, pairs array<long>, held_by array<int>, entries binary, piece int, own array<int>, start array<long>, size array<long>, a binary, b binary"
_PART = "slice long, piece int, doc_id long, cuts long, links long, size array<long>, head_a binary, head_b binary, body binary, tail_a binary, tail_b binary, pairs array<long>, times array<int>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _kept(key: tuple, make):
    """One object a worker, kept from task to task."""
    kept = sys.modules.setdefault("tabflow_kept_vocabularies", types.ModuleType("tabflow_kept_vocabularies")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Vocabulary(NamedTuple):
    """The bytes of each token, and its id as text with what may follow it."""

    bytes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    comma: list[bytes]
    close: list[bytes]

    @classmethod
    def of(cls, tokens: Sequence[bytes], close: bytes) -> Vocabulary:
        size = np.array([len(t) for t in tokens], np.int64)
        ids = [str(i).encode() for i in range(len(tokens))]
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size, [i + b"," for i in ids], [i + close for i in ids])

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def byte_level_vocabulary(path: str) -> Vocabulary:
    from tokenizers import Tokenizer

    from tabflow.llm.tokens import _SPELLED

    byte = {c: b for b, c in _SPELLED.items()}
    ids = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else b""
    return Vocabulary.of(tokens, b"|")


def piece_vocabulary(path: str) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    spell = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return Vocabulary.of([spell(i) for i in range(model.get_piece_size())], b";")


class PieceEncoder:
    """Encodes with ``sentencepiece`` and remembers the ids of what stands between blanks.

    No piece of the vocabulary holds a blank behind another character, so no merge crosses such a place and the ids of a text are those of
    its parts, cut there. A model with such a piece is not cut.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.known: dict[str, np.ndarray] = {}
        self.whole = any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))

    def encode(self, text: str) -> np.ndarray:
        if self.whole or "▁" in text or not text:
            return np.array(self.model.encode(text), np.uint32)
        parts = text.split(" ")
        if "" in parts:
            parts = [p[1:] for p in re.findall(" +[^ ]*", " " + text)]
        new = set(parts).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known.clear()
                new = set(parts)
            new = list(new)
            for part, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
                # A part is written without its first blank; the model adds one, but not to an empty text.
                self.known[part] = np.array(ids if part else [self.model.piece_to_id("▁")], "<u4").tobytes()
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")


class _Tools(NamedTuple):
    a: Vocabulary
    b: Vocabulary


def _tools(paths: tuple[str, str]) -> _Tools:
    return _kept(paths, lambda: _Tools(byte_level_vocabulary(paths[0]), piece_vocabulary(paths[1])))


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """Where each ``work`` merged ends of two ascending lists begin, as (place in a, place in b); equal ends stay on one side."""
    at = np.arange(work, len(a) + len(b), work)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        further = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(at - mid - 1, 0, len(b) - 1)])
        low, high = np.where(further, mid + 1, low), np.where(open_ & ~further, mid, high)
    i, j = low, at - low
    j = j + ((i > 0) & (j < len(b)) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)]))
    return [(0, 0), *dict.fromkeys(zip(i.tolist(), j.tolist(), strict=True)), (len(a), len(b))]


class Merged(NamedTuple):
    ends: np.ndarray  #: different ends, one link each
    pairs: np.ndarray  #: the link's ids
    cuts: np.ndarray  #: ends of both
    texts: list[bytes]  #: ids in the order of groups, each with what follows it
    group: np.ndarray  #: the number of cuts before each of these
    of_a: np.ndarray  #: whether each is one of A


def merge(tools: _Tools, a: np.ndarray, b: np.ndarray, a_start: int = 0, b_start: int = 0, a_own: int | None = None, b_own: int | None = None) -> Merged:
    """Links and groups of a piece; tokens beyond those it owns only serve to name links."""
    a_own, b_own = len(a) if a_own is None else a_own, len(b) if b_own is None else b_own
    a_ends, b_ends = a_start + np.cumsum(tools.a.size[a]), b_start + np.cumsum(tools.b.size[b])
    ends = np.concatenate([a_ends[:a_own], b_ends[:b_own]])
    ends.sort(kind="stable")  # two ascending runs
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    cuts = ends[(a_ends[i] == ends) & (b_ends[j] == ends)]
    pairs = (a[i].astype(np.int64) << _SHIFT) | b[j].astype(np.int64)
    key = np.concatenate([np.searchsorted(cuts, a_ends[:a_own]) * 2, np.searchsorted(cuts, b_ends[:b_own]) * 2 + 1])
    order = np.argsort(key, kind="stable")
    key = key[order]
    last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
    n_a, n_b = len(tools.a.comma), len(tools.b.comma)
    code = np.concatenate([a[:a_own].astype(np.int64), b[:b_own].astype(np.int64) + 2 * n_a])[order]
    code += last * np.where(key % 2 == 0, n_a, n_b)
    spelled = _kept((id(tools), "spelled"), lambda: [*tools.a.comma, *tools.a.close, *tools.b.comma, *tools.b.close])
    return Merged(ends, pairs, cuts, list(map(spelled.__getitem__, code.tolist())), key // 2, key % 2 == 0)


def _packed(place: np.ndarray, times: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([place, times]).astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(entries: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(entries, 8 * n, codec="zstd", asbytes=True), "<u4") if n else np.zeros(0, np.uint32)
    return both[:n], both[n:]


class _Slice:
    """Documents that are aligned, until they are handed on as one row."""

    def __init__(self):
        self.ids, self.counts, self.digests, self.pairs, self.times, self.held = [], [], [], [], [], 0

    def add(self, doc_id, counts: Sequence[int], digest: str, pairs: np.ndarray, times: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts += [*counts, len(pairs)]
        self.digests.append(digest)
        self.pairs.append(pairs)
        self.times.append(times)
        self.held += len(pairs)

    def row(self, number: int) -> pa.RecordBatch:
        every = np.concatenate([np.zeros(0, np.int64), *self.pairs])
        pairs, place = np.unique(every, return_inverse=True)
        times = np.concatenate([np.zeros(0, np.int64), *self.times])
        return _row(slice=number, doc_ids=self.ids, counts=self.counts, digests=self.digests, pairs=pairs, held_by=np.bincount(place, minlength=len(pairs)).astype(np.int32), entries=_packed(place, times))


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in _ROW], schema=_ROW)


def _aligner(paths: tuple[str, str], work: int, slice_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tools = _tools(paths)
        encode_a = _kept((*paths, "a"), lambda: Encoder(paths[0], plain=True))
        encode_b = _kept((*paths, "b"), lambda: PieceEncoder(paths[1]))
        number = TaskContext.get().partitionId() << 32
        held, waiting, size = _Slice(), [], 0

        def align() -> None:
            if waiting:
                a, b = (np.concatenate([w[k] for w in waiting]) for k in (1, 2))
                m = merge(tools, a, b)
                bounds = np.cumsum([w[3] for w in waiting])
                of = np.searchsorted(bounds, m.ends)
                links, groups = np.bincount(of, minlength=len(waiting)), np.bincount(np.searchsorted(bounds, m.cuts), minlength=len(waiting))
                order = np.lexsort((m.pairs, of))
                p, o = m.pairs[order], of[order]
                first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (o[1:] != o[:-1])))
                times = np.diff(np.append(first, len(p)))
                begin = np.searchsorted(o[first], np.arange(len(waiting) + 1))
                at = 0
                for k, (doc_id, ids_a, ids_b, _) in enumerate(waiting):
                    to = at + len(ids_a) + len(ids_b)
                    digest = hashlib.sha256(b"".join(m.texts[at:to])[:-1]).hexdigest()
                    mine = slice(begin[k], begin[k + 1])
                    held.add(doc_id, (len(ids_a), len(ids_b), int(groups[k]), int(links[k])), digest, p[first[mine]], times[mine])
                    at = to
                waiting.clear()

        for batch in batches:
            texts = batch.column(1).to_pylist()
            full = [" " + t if t else None for t in texts]
            for doc_id, text, a in zip(batch.column(0).to_pylist(), full, encode_a.encode(full), strict=True):
                data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8) if text else None
                b = encode_b.encode(text[1:]) if text and "▁" not in text else None
                if b is None or tools.a.size[a].sum() != len(data) or tools.b.size[b].sum() != len(data) or (tools.a.spelled(a) != data).any() or (tools.b.spelled(b) != data).any():
                    held.add(doc_id, (0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64))
                elif len(a) + len(b) > work:
                    a_ends, b_ends = np.cumsum(tools.a.size[a]), np.cumsum(tools.b.size[b])
                    cut = diagonals(a_ends, b_ends, work)
                    for k, ((i, j), (i1, j1)) in enumerate(zip(cut, cut[1:], strict=False)):
                        start = [int(a_ends[i - 1]) if i else 0, int(b_ends[j - 1]) if j else 0]
                        ids = {"a": a[i : i1 + 1].astype("<u4").tobytes(), "b": b[j : j1 + 1].astype("<u4").tobytes()}
                        yield _row(slice=number, doc_ids=[doc_id], piece=k, own=[i1 - i, j1 - j], start=start, size=[len(a), len(b)], **ids)
                    number += 1
                else:
                    waiting.append((doc_id, a, b, len(data)))
                    size += len(a) + len(b)
                    if size >= work:
                        align()
                        size = 0
                if held.held >= slice_pairs or len(held.ids) >= slice_pairs:
                    yield held.row(number)
                    held, number = _Slice(), number + 1
        align()
        if held.ids:
            yield held.row(number)

    return run


def _merger(paths: tuple[str, str]):
    """Pieces of long documents: their links, whole groups, and what is open at either end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(paths)
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in ("slice", "piece", "doc_ids", "own", "start", "size", "a", "b")}
                m = merge(tools, np.frombuffer(r["a"], "<u4"), np.frombuffer(r["b"], "<u4"), *r["start"], *r["own"])
                n = len(m.cuts)
                pairs, times = np.unique(m.pairs, return_counts=True)
                span = lambda lo, hi, a: b"".join(m.texts[x] for x in np.flatnonzero((m.group >= lo) & (m.group < hi) & (m.of_a == a)).tolist())[:-1]
                body = b"".join(m.texts[np.searchsorted(m.group, 1) : np.searchsorted(m.group, n)])
                tail = (span(n, n + 1, True), span(n, n + 1, False)) if n else (b"", b"")
                values = [r["slice"], r["piece"], r["doc_ids"][0], n, len(m.ends), r["size"], span(0, 1, True), span(0, 1, False), body, *tail, pairs, times.astype(np.int32)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in _PART.split(", ")])

    return run


def _stitch(table: pa.Table) -> pa.Table:
    """The pieces of one document as a slice of its own."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    digest, carry_a, carry_b, first = hashlib.sha256(), [], [], True
    for r in rows:
        carry_a += [r["head_a"]] if r["head_a"] else []
        carry_b += [r["head_b"]] if r["head_b"] else []
        if r["cuts"]:
            digest.update(b"" if first else b";")
            digest.update(b",".join(carry_a) + b"|" + b",".join(carry_b) + (b";" + r["body"][:-1] if r["body"] else b""))
            first, carry_a, carry_b = False, [r["tail_a"]] if r["tail_a"] else [], [r["tail_b"]] if r["tail_b"] else []
    every, times = (np.concatenate([np.array(r[c], np.int64) for r in rows]) for c in ("pairs", "times"))
    pairs, place = np.unique(every, return_inverse=True)
    out = _Slice()
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, place, times)
    out.add(rows[0]["doc_id"], (*rows[0]["size"], sum(r["cuts"] for r in rows), sum(r["links"] for r in rows)), digest.hexdigest(), pairs, sums)
    return pa.Table.from_batches([out.row(rows[0]["slice"])])


def aligned_slices(documents: DataFrame, path_a: str, path_b: str, work: int = WORK, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """Rows of slices: documents with their counts, digests and pairs; written."""
    paths = (path_a, path_b)
    first = materialize(documents_of(documents).mapInArrow(_aligner(paths, work, slice_pairs), _ROW_SQL), "align-slices")
    cut = first.filter("piece IS NOT NULL").select("slice", "piece", "doc_ids", "own", "start", "size", "a", "b")
    pieces = cut.repartition("slice", "piece").mapInArrow(_merger(paths), _PART)
    whole = materialize(pieces.groupBy("slice").applyInArrow(_stitch, _ROW_SQL), "align-stitched")
    return first.filter("piece IS NULL").union(whole).select("slice", "doc_ids", "counts", "digests", "pairs", "held_by", "entries")


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair (A id above the low 32 bits), count (documents that hold it linked), best (whether none of its A id's pairs has more); written."""
    held = slices.select(F.explode(F.arrays_zip("pairs", "held_by")).alias("at"))
    counts = materialize(held.groupBy(F.col("at.pairs").alias("pair")).agg(F.sum("at.held_by").alias("count")), "align-counts")
    a = F.shiftright("pair", _SHIFT).alias("a")
    most = counts.groupBy(a).agg(F.max("count").alias("most"))
    return materialize(counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "align-best")


def _count(slices: pa.Table, looked: pa.Table) -> pa.Table:
    """The documents of one slice, with what the corpus says of their links."""
    count, best = np.zeros(looked.num_rows, np.int64), np.zeros(looked.num_rows, np.int64)
    place = looked.column("place").to_numpy()
    count[place], best[place] = looked.column("count").to_numpy(), looked.column("best").to_numpy(zero_copy_only=False)
    out: list[pa.Table] = []
    for r in range(slices.num_rows):
        ids = slices.column("doc_ids")[r].values
        counts = slices.column("counts")[r].values.to_numpy().reshape(-1, 5)
        place, times = _unpacked(slices.column("entries")[r].as_py(), int(counts[:, 4].sum()))
        bounds = np.append(0, np.cumsum(counts[:, 4]))
        total = lambda v: np.diff(np.append(0, np.cumsum(v * times.astype(np.int64)))[bounds])
        columns = [ids, *(counts[:, k] for k in range(4)), total(best[place]), total(count[place]), slices.column("digests")[r].values]
        out.append(pa.table([pa.array(c) for c in columns], [c.split()[0] for c in _OUT.split(", ")]))
    return pa.concat_tables(out)


def align(documents: DataFrame, path_a: str, path_b: str, work: int = WORK, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row; other columns are not read.

    A is a byte-level vocabulary of ``tokenizers`` for a blank and the text, B one of ``sentencepiece`` for the text; special tokens are
    plain text. Null and empty texts, and texts that a vocabulary does not spell byte by byte, have no tokens: zeros and ''. Rows that
    repeat an id or a text each are a document. Texts are read whole, at any length. An empty table gives no rows.
    """
    slices = aligned_slices(documents, path_a, path_b, work, slice_pairs)
    known = pair_counts(slices)
    wanted = slices.select("slice", F.posexplode("pairs").alias("place", "pair"))
    looked = wanted.join(known, "pair").select(F.col("slice").alias("of"), "place", "count", "best")
    read = slices.select("slice", "doc_ids", "counts", "digests", "entries")
    return read.groupBy("slice").cogroup(looked.groupBy("of")).applyInArrow(_count, _OUT)
