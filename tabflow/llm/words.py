"""Words and shingles of whole Arrow text columns as numpy arrays.

A word is a run of bytes other than blank and 0x09-0x0D; multi-byte characters are never split, as their bytes lie above.
Hashes are 64 bits wide: two different sequences share one with a probability of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWERED = _BYTES.copy()
_LOWERED[65:91] = _BYTES[97:123]
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown to the longest text seen in this process."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            grown = np.full((2, size), 1, np.uint64)
            grown[0, 1:], grown[1, 1:] = _U(_BASE), _U(_INVERSE)
            cls.up, cls.down = np.cumprod(grown[0]), np.cumprod(grown[1])
        return cls.up[:n], cls.down[:n]


class Words(NamedTuple):
    row: int  #: index in the column of the first text
    texts: int
    data: np.ndarray  #: the bytes of all texts
    offsets: np.ndarray  #: texts + 1 places in data
    start: np.ndarray  #: place of each word in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: texts + 1 places in start


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of texts of about ``most`` bytes; a longer text is a run of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each span of bytes."""
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a text column, slice by slice."""
    for row, offsets, data in slices(column, most):
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        up, down = _Powers.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWERED if lower else _BYTES)[data] * up[:-1], out=sums[1:])
        hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        yield Words(row, len(offsets) - 1, data, offsets, start, end, hashed, np.searchsorted(start, offsets))


def sequence_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``n`` word hashes; there are ``len(hashes) - n + 1``. Runs may span texts: the caller knows where these end."""
    total = np.full(max(0, len(hashes) - n + 1), ((seed * 2 + 1) * 0xD1B54A32D192ED03 + n) % (1 << 64), np.uint64)
    for j in range(n):
        total = mix(total ^ hashes[j : j + len(total)]) + _U(j)
    return total


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; with fewer words the whole sequence as one; empty without words."""
    every, out = sequence_hashes(w.hash, n), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        else:
            out.append(sequence_hashes(w.hash[a:b], b - a, seed=1) if b > a else np.zeros(0, np.uint64))
    return out
