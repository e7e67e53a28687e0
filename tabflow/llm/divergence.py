"""Divergence of the sources of a language, term by term, over the terms that enough of its documents hold.

The kept terms are found by iceberg prefix refinement. A term's bytes end with a zero byte, which no term holds, so that a complete term
is one more prefix. Prefixes of 8, 16, 32, ... bytes are counted by distinct documents; those of fewer than ``least`` documents are
discarded with all terms below them, and only what is left is extended, until every prefix left is a complete term.

Documents are read once, by slices: a slice hands on each of its terms with its occurrences per source, and the number of its documents
that hold each prefix, at one of the terms below that prefix. A document lies in one slice, so the numbers of the slices add up. They stop
at ``least``: more cannot change whether a prefix reaches it.

Shares of pairs of sources are summed over blocks of terms: a sum over all kept terms is that of terms without occurrences in either
source, corrected where one or both have some, so a block costs what its terms' sources cost, not terms times sources squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.shared import measured
from tabflow.llm.words import byte_hashes, mix, slices
from tabflow.session import materialize

LEAST = 3
TOP = 200
SLICE_BYTES = 16 << 20
#: Texts whose bytes are hashed at a time, which takes some forty times their size.
RUN_BYTES = 1 << 19
FIRST = 8
SCALE = 1_000_000_000
BLOCK_CELLS = 20_000
PAIRS_AT_ONCE = 1 << 21
#: Sums of all pairs of so many sources are held as one array.
MOST_DENSE = 1024
_SLICES = "slice long, lang string, term binary, docs array<int>, sources array<string>, counts array<long>"
_NAMES = [f.split()[0] for f in _SLICES.split(", ")]
#: A-Z lower-cased; bytes that belong to no term are blanks. Bytes of multi-byte characters lie above 0x7F.
_TO_TERMS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """One list an owner from values in order of their owners 0 to n - 1."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=n))), pa.int32()), values)


def _spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bytes of a run of texts with blanks between terms, and the start, end, hash and text of each term."""
    low = _TO_TERMS[data]
    inside = low != 32
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before, after = np.append(False, inside[:-1])[: len(low)], np.append(inside[1:], False)[: len(low)]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return low, start, end, byte_hashes(low, start, end), np.searchsorted(offsets, start, "right") - 1


def _prefix_documents(spelled: np.ndarray, start: np.ndarray, size: np.ndarray, lang: np.ndarray, term: np.ndarray, doc: np.ndarray, texts: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each term, the documents of the slice that hold its prefix of FIRST, 2 * FIRST, ... bytes, up to the first that is the whole term.

    The number stands at one of the terms below a prefix, and is 0 at the others. ``term`` and ``doc`` are the different pairs. Returns
    the term of each number, ascending, and the numbers.
    """
    owner, found, open_, length = [], [], np.arange(len(size)), FIRST
    while len(open_):
        number = np.zeros(len(size), np.int64)
        whole, longer = open_[size[open_] <= length], open_[size[open_] > length]
        number[whole] = np.bincount(term, minlength=len(size))[whole]
        if len(longer):
            prefix = mix(byte_hashes(spelled, start[longer], start[longer] + length) ^ mix(lang[longer].astype(np.uint64) + np.uint64(1)))
            _, one, same = np.unique(prefix, return_index=True, return_inverse=True)
            of = np.full(len(size), -1)
            of[longer] = same
            below = of[term] >= 0
            pairs = np.unique(of[term[below]] * texts + doc[below])
            number[longer[one]] = np.bincount(pairs // texts, minlength=len(one))
        owner.append(open_)
        found.append(np.minimum(number[open_], least))
        open_, length = longer, 2 * length
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(owner)[order], np.concatenate(found)[order]


def _slice(number: int, runs: list[tuple], lang: pa.DictionaryArray, source: pa.DictionaryArray, least: int) -> pa.RecordBatch:
    """One row a (lang, term) of consecutive runs of texts; terms are told apart by a hash of 64 bits within the slice."""
    found = [_spans(offsets, data) for offsets, data in runs]
    bytes_before, texts_before = (np.cumsum([0, *sizes]) for sizes in ([len(data) for _, data in runs], [len(offsets) - 1 for offsets, _ in runs]))
    low, hashes = (np.concatenate([f[k] for f in found]) for k in (0, 3))
    start, end = (np.concatenate([f[k] + n for f, n in zip(found, bytes_before, strict=False)]) for k in (1, 2))
    doc = np.concatenate([f[4] + n for f, n in zip(found, texts_before, strict=False)])
    del found
    of_lang, of_source = (c.indices.to_numpy().astype(np.int64) for c in (lang, source))
    key = mix(hashes ^ mix(of_lang[doc].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")  # documents stay in order
    key, doc = key[order], doc[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    term = np.cumsum(new) - 1
    n = int(term[-1]) + 1 if len(term) else 0
    first = np.flatnonzero(new)

    met = np.flatnonzero(new | np.append(True, doc[1:] != doc[:-1])[: len(doc)])
    code, times = np.unique(term * len(source.dictionary) + of_source[doc], return_counts=True)

    at = order[first]
    size = end[at] - start[at] + 1
    ends = np.cumsum(size)
    spelled = low[np.minimum(np.repeat(start[at] - (ends - size), size) + np.arange(size.sum()), max(len(low) - 1, 0))]
    spelled[ends - 1] = 0
    levels, docs = _prefix_documents(spelled, ends - size, size, of_lang[doc[first]], term[met], doc[met], texts_before[-1], least)
    name = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(spelled.tobytes())])
    columns = [
        pa.array(np.full(n, number, np.int64)),
        lang.dictionary.take(pa.array(of_lang[doc[first]])),
        name,
        _lists(levels, n, pa.array(docs, pa.int32())),
        _lists(code // len(source.dictionary), n, source.dictionary.take(pa.array(code % len(source.dictionary)))),
        _lists(code // len(source.dictionary), n, pa.array(times, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _slicer(least: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lang, source = (batch.column(i).dictionary_encode() for i in range(2))
            runs, size, begin = [], 0, 0
            for row, offsets, data in slices(batch.column(2), min(RUN_BYTES, slice_bytes)):
                runs.append((offsets, data))
                size, to = size + len(data), row + len(offsets) - 1
                if size >= slice_bytes or to == batch.num_rows:
                    found = _slice(number, runs, lang.slice(begin, to - begin), source.slice(begin, to - begin), least)
                    runs, size, begin, number = [], 0, to, number + 1
                    for at in range(0, found.num_rows, 50_000):
                        yield found.slice(at, 50_000)

    return run


def slices_of(documents: DataFrame, least: int = LEAST, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The terms of each slice, written once; null lang, source and text count as empty."""
    plain = lambda c: F.coalesce(documents[c].cast("string"), F.lit("")).alias(c)
    read = documents.select(plain("lang"), plain("source"), plain("text"))
    return materialize(read.mapInArrow(_slicer(least, slice_bytes), _SLICES), "terms-slices")


def _prefixes(left: DataFrame, level: int, least: int) -> DataFrame:
    """(lang, prefix) of the prefixes of a level in at least ``least`` documents; written."""
    docs = F.get("docs", F.lit(level))
    at = left.filter(docs > 0).select("lang", F.substring("term", 1, FIRST << level).alias("prefix"), docs.alias("n"))
    return materialize(at.groupBy("lang", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "prefix"), "terms-prefixes")


def _hashed(df: DataFrame) -> DataFrame:
    """Kept terms or prefixes for a semi-join: by broadcast if small, else by a hash table of each part, so that the many terms aren't sorted."""
    near = measured(df)
    return near if near is not df else df.hint("shuffle_hash")


def kept_terms(slices: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term) of all terms in at least ``least`` documents of their language; a written table, terms with their end byte."""
    left = slices.select("lang", "term", "docs")
    longest = slices.agg(F.max(F.octet_length("term"))).first()[0] or 0
    live, level, done = left, 0, []
    while True:
        found = _prefixes(live, level, least)
        ended = F.substring("prefix", -1, 1) == F.lit(b"\0")
        done.append(found.filter(ended).select("lang", F.col("prefix").alias("term")))
        open_ = found.filter(~ended)
        if FIRST << level >= longest or open_.isEmpty():
            break
        # A prefix that is left lies below one that was left a level before, so the last level's are enough.
        longer = left.filter(F.octet_length("term") > FIRST << level).withColumn("prefix", F.substring("term", 1, FIRST << level))
        live = longer.join(_hashed(open_), ["lang", "prefix"], "left_semi").drop("prefix")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return materialize(out, "terms-kept")


def _p(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (N + V)) in whole numbers of any size; null without kept terms."""
    of = F.nullif(total + kept, F.lit(0)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(17,0)") * (count + 1).cast("decimal(19,0)"), of)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: pa.Table) -> pa.Table:
    """For a block of terms, what pairs of sources change where both have a term, against each having none of it."""
    lang, term, source = batches.column("lang")[0], batches.column("term"), batches.column("source")
    source, term = (c.combine_chunks().dictionary_encode() for c in (source, term))
    names, at, row = np.array(source.dictionary.to_pylist(), object), *(c.indices.to_numpy().astype(np.int64) for c in (source, term))
    order = np.argsort(row, kind="stable")
    row, at = row[order], at[order]
    p, none = (batches.column(c).to_numpy()[order] for c in ("p", "p0"))
    first = np.searchsorted(row, row)
    many = np.searchsorted(row, row, "right") - first
    f = lambda x, y: (x - y) * (x - y) // y
    keys, low, high = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(many)
    start = 0
    while start < len(row):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        n = many[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + first[left]
        changed = f(p[left], p[right]) - f(p[left], none[right]) - f(none[left], p[right]) + f(none[left], none[right])
        code = at[left] * len(names) + at[right]
        if len(names) <= MOST_DENSE:
            # Sums of floats below 2**53 are exact: halves of 32 bits of at most 2**21 numbers.
            here = np.arange(len(names) ** 2)
            small, large = (np.bincount(code, half, len(here)).astype(np.int64) for half in (changed & 0xFFFFFFFF, changed >> 32))
        else:
            order = np.argsort(code, kind="stable")
            here, begin = np.unique(code[order], return_index=True)
            small, large = (np.add.reduceat(half[order], begin) for half in (changed & 0xFFFFFFFF, changed >> 32))
        if len(keys) == len(here) == len(names) ** 2:
            low, high = low + small, high + large
        else:
            keys, place = np.unique(np.concatenate([keys, here]), return_inverse=True)
            both = []
            for old, new in ((low, small), (high, large)):
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, place, np.concatenate([old, new]))
                both.append(total)
            low, high = both
        start = stop
    one, other = keys // len(names), keys % len(names)
    value = [(h << 32) + v for h, v in zip(high.tolist(), low.tolist(), strict=True)]
    return pa.table({"lang": pa.array([lang.as_py()] * len(value), pa.string()), "source": pa.array(names[one], pa.string()), "item": pa.array(names[other], pa.string()), "value": pa.array(value, pa.int64())})


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two different sources of a language.

    The sum over all V terms: V terms that neither has, then for the terms that one of them has, then for those that both have, what
    changes. One-sided changes depend on p alone, so they are summed over the different p of a source.
    """
    blocks = max(1, -(-cells.count() // BLOCK_CELLS))
    both = cells.select("lang", "source", "term", "p", "p0", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    both = both.groupBy("lang", "block").applyInArrow(_both, "lang string, source string, item string, value long").filter("source <> item")
    wide = F.col("value").cast("decimal(38,0)")
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    histogram = cells.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    sided = histogram.join(others, "lang").filter("source <> other")
    change = lambda x, y: F.sum((F.col("n").cast("decimal(20,0)") * (x - y)).cast("decimal(38,0)"))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    sided = sided.groupBy("lang", "source", "other").agg(change(_f(p, q0), _f(p0, q0)).alias("has"), change(_f(q0, p), _f(q0, p0)).alias("lacks"))
    has = sided.select("lang", "source", F.col("other").alias("item"), F.col("has").alias("value"))
    lacks = sided.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.col("lacks").alias("value"))
    neither = groups.join(others, "lang").filter("source <> other")
    neither = neither.select("lang", "source", F.col("other").alias("item"), (F.col("kept").cast("decimal(20,0)") * F.coalesce(_f(p0, q0), F.lit(0))).cast("decimal(38,0)").alias("value"))
    every = both.select("lang", "source", "item", wide.alias("value")).union(has).union(lacks).union(neither)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def divergence(documents: DataFrame, least: int = LEAST, top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its other sources, and by which terms from its language.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the source has more often. A document is a
    row: rows that repeat an id are documents of their own. Null lang, source and text count as empty, and such groups are groups like
    others; a group without terms has pairs of value 0 where its language keeps none. Other columns are not read. A text is read whole; a
    task holds the terms of one slice, or of one text if that is longer. Ties rank by the bytes of the item. An empty table gives no rows.
    """
    plain = lambda c: F.coalesce(documents[c].cast("string"), F.lit("")).alias(c)
    cut = slices_of(documents, least, slice_bytes)
    kept = kept_terms(cut, least)
    held = cut.join(_hashed(kept), ["lang", "term"], "left_semi").select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("at"))
    summed = held.groupBy("lang", "term", F.col("at.sources").alias("source")).agg(F.sum("at.counts").alias("count"))
    # One row a term: the sources of a term lie together already, and what the language has of it is their sum.
    terms = summed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "count")).alias("at"), F.sum("count").alias("whole"))
    counts = materialize(terms, "terms-counts").select("lang", "term", "whole", F.inline("at"))

    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = documents.select(plain("lang"), plain("source")).distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.fillna(0, ["total", "kept"]).withColumn("p0", _p(F.lit(0), F.col("total"), F.col("kept")))
    groups = materialize(groups, "terms-groups")

    groups = materialize(groups, "terms-groups")
    of_lang = groups.groupBy("lang", "kept").agg(F.sum("total").alias("sum"))
    near = measured(materialize(groups.join(of_lang, ["lang", "kept"]), "terms-shares"))
    cells = counts.join(near, ["lang", "source"])
    q = _p(F.col("whole"), F.col("sum"), F.col("kept")).alias("q")
    cells = materialize(cells.select("lang", "source", "term", "count", "p0", _p(F.col("count"), F.col("total"), F.col("kept")).alias("p"), q), "terms-cells")
    pairs = _pairs(cells, near)

    name = F.decode(F.expr("substring(term, 1, octet_length(term) - 1)"), "UTF-8")
    more = cells.filter("p > q").select("lang", "source", name.alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda df, which: df.select("lang", "source", F.lit(which).alias("part"), "item", "value", rank.alias("rank"))
    return part(pairs, "pair").union(part(more, "term").filter(F.col("rank") <= top))
