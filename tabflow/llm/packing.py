"""Best-fit packing of token pieces into sequences of a fixed length, in bulk-synchronous sweeps.

Pieces of one length are alike, and so are gaps of one size. Spark counts the pieces of each length, so a sweep runs over length classes,
at most ``capacity`` of them however large the corpus is. In a sweep every class of pieces, longest first, looks up its successor: the
smallest open gap that holds it. Where several classes want the same gaps, the longer ones come first by rank, and the rest waits.
Then gaps are updated, and sweeps repeat until no piece finds a gap; then the longest pieces left open as many new sequences as the
tokens left would fill. What comes out are runs: pieces of one length with ranks from a to b lie in consecutive sequences at one offset.
Pieces get their ranks within a length in parallel, salted, and find their run by binary search in their tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.shared import documents_of
from tabflow.llm.tokens import encoder
from tabflow.session import materialize

CAPACITY = 4096
#: Ranks within a length are given by so many groups in parallel.
SALTS = 32
_RANK_BITS = 44


def encode_pieces(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece (from 0), start (ids of its document before it), length, ids_crc32, and the ids as unsigned 32-bit integers if asked for.

    A text's ids with ``end_id`` after them are cut into pieces of ``capacity``; the last may be shorter. A null text is empty and
    gives one piece with the end alone.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part, rows = batch.slice(at, 1000), []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), known.encode(part["text"]), strict=True):
                    ids = np.concatenate([ids, end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity].tobytes()
                        rows.append((doc_id, k, start, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    pieces = documents_of(documents).mapInArrow(encoded, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return pieces if with_ids else pieces.drop("ids")


class _Gaps:
    """Open sequences by the size of their gap; those of one size as runs of consecutive numbers."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, size: int, first: int, n: int) -> None:
        if size:
            if size not in self.runs:
                insort(self.sizes, size)
                self.runs[size] = []
            self.runs[size].append((first, n))

    def successor(self, length: int) -> int | None:
        at = bisect_left(self.sizes, length)
        return self.sizes[at] if at < len(self.sizes) else None

    def open(self, size: int) -> int:
        return sum(n for _, n in self.runs[size])

    def take(self, size: int, n: int) -> Iterator[tuple[int, int]]:
        runs = self.runs[size]
        while n:
            first, have = runs.pop()
            used = min(n, have)
            if used < have:
                runs.append((first + used, have - used))
            n -= used
            yield first, used
        if not runs:
            del self.runs[size]
            self.sizes.remove(size)


def plan_sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that place all pieces, given how many there are of each length."""
    left = {l: n for l, n in counts.items() if n and l}
    rank, gaps, runs, sequences = defaultdict(int), _Gaps(), [], 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    while left:
        wanted = defaultdict(list)
        for length in sorted(left, reverse=True):
            size = gaps.successor(length)
            if size is not None:
                wanted[size].append(length)
        if wanted:
            moved = []
            for size, lengths in wanted.items():
                free = gaps.open(size)
                for length in lengths:
                    n = min(free, left[length])
                    for first, used in gaps.take(size, n) if n else ():
                        place(length, used, first, capacity - size)
                        moved.append((size - length, first, used))
                    free -= n
            for gap in moved:
                gaps.add(*gap)
            continue
        # Pieces longer than half a sequence never share one; of the others, as many open one as the tokens left would fill.
        fresh = sum(n for l, n in left.items() if 2 * l > capacity) or max(1, sum(l * n for l, n in left.items()) // capacity)
        for length in sorted(left, reverse=True):
            n = min(fresh, left[length])
            if not n:
                break
            place(length, n, sequences, 0)
            gaps.add(capacity - length, sequences, n)
            sequences += n
            fresh -= n
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of ``pieces`` (a written table with doc_id, piece, start, ids_crc32, length <= capacity), and sequence_id and offset.

    Pieces without tokens get sequence -1. Rows that are equal are pieces of their own. An empty table gives no rows.
    """
    names = pieces.columns
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).orderBy("length", "salt").toPandas()  # at most capacity x SALTS rows
    if len(counted) and int(counted["length"].max()) > capacity:
        raise ValueError("a piece is longer than a sequence")
    runs = sorted(plan_sweeps(counted.groupby("length")["n"].sum().to_dict(), capacity))
    length, first_rank, _, first, offset = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 5
    key = (length << _RANK_BITS) | first_rank
    before = (counted.groupby("length")["n"].cumsum() - counted["n"]).to_numpy()
    salt_key = counted["length"].to_numpy() * SALTS + counted["salt"].to_numpy()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            rank = before[np.searchsorted(salt_key, of * SALTS + batch["salt"].to_numpy(zero_copy_only=False))] + batch["rank"].to_numpy(zero_copy_only=False)
            run = np.maximum(0, np.searchsorted(key, (of << _RANK_BITS) | rank, "right") - 1)
            empty = of == 0
            sequence = np.where(empty, -1, first[run] + rank - first_rank[run] if len(key) else -1)
            place = np.where(empty, 0, offset[run] if len(key) else 0)
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(sequence, pa.int64()), pa.array(place, pa.int64())], [*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).select(*names, "salt", "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(placed, schema)


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Encodes, cuts and packs whole texts: one row per piece."""
    return pack(materialize(encode_pieces(documents, tokenizer, end_id, capacity), "pieces"), capacity)
