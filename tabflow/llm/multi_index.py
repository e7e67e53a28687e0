"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by a codebook of its own; a cell of the index is a pair of centroids. A query walks the
pairs in order of summed squared distance with a heap, until the cells hold the share of the index that reached the wanted recall
for the queries of a sample, and every entry of those cells is ranked by its exact distance.

Equal vectors are one entry. An entry keeps its k + 1 smallest different ids, which is all that k neighbours can need, as ties go to
smaller ids; so a vector that a third of all rows share is one entry, too. Cells are dealt in runs of some thousand entries, and these in
blocks of entries and of queries: a block hands on a query's best of all its cells at once, under the query's number, not its vector.

Queries of one vector share a list of candidates. It is long enough for any of them after its own id is taken out: if an id has at
most c vectors, k + c candidates are; if c is above k, each id stays with its k nearest vectors only, and 2 k candidates are.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.shared import measured
from tabflow.session import materialize

#: Codebooks and the share to visit are fitted on so many distinct vectors at most, those whose hashes come first.
SAMPLE = 16_384
SAMPLE_QUERIES = 200
RECALL = 0.97
#: Centroids of a half: the square root of the number of entries over PER_ROOT, between LEAST and MOST.
PER_ROOT, LEAST, MOST = 8, 4, 256
ITERATIONS = 12
#: A query never visits fewer entries than this.
LEAST_ENTRIES = 1000
ENTRY_BLOCK, QUERY_BLOCK = 32_768, 4096
#: Queries of a block that are compared at a time.
ROWS_AT_ONCE = 64


class Codebooks(NamedTuple):
    first: np.ndarray
    second: np.ndarray
    share: float  #: of all entries, to visit


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * x @ c.T)


def _roughly(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and for each row of ``x`` a bound of what rounding changes in them."""
    of_x, of_y = (x**2).sum(axis=1), (y**2).sum(axis=1)
    off = 4 * (x.shape[1] + 8) * np.finfo(float).eps * (of_x + of_y.max())
    return of_x[:, None] + of_y[None, :] - 2 * x @ y.T, off


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ITERATIONS):
        own = _squared(x, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def cells_in_order(to_first: np.ndarray, to_second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by summed distance: a heap holds the frontier of the two sorted lists."""
    one, two = np.argsort(to_first, kind="stable"), np.argsort(to_second, kind="stable")
    a, b = to_first[one].tolist(), to_second[two].tolist()
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(one[i]), int(two[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))


def runs_of_cells(sizes: dict[int, int], most: int = ENTRY_BLOCK) -> tuple[dict[int, int], dict[int, int]]:
    """The run of each cell, and the entries of each run: neighbouring cells of together at most ``most`` entries, or one larger cell."""
    run_of, entries_of, run = {}, {}, -1
    for cell in sorted(sizes):
        if run < 0 or entries_of[run] + sizes[cell] > most:
            run += 1
            entries_of[run] = 0
        run_of[cell] = run
        entries_of[run] += sizes[cell]
    return run_of, entries_of


def fit(sample: np.ndarray, entries: int, k: int, recall: float = RECALL) -> Codebooks:
    """Codebooks from a sample of distinct vectors, and the share of a walk that finds ``recall`` of its k nearest."""
    half = sample.shape[1] // 2
    size = int(np.clip(2 ** round(np.log2(max(1.0, entries**0.5 / PER_ROOT))), LEAST, MOST))
    first, second = _k_means(sample[:, :half], size, 1), _k_means(sample[:, half:], size, 2)
    cell = _squared(sample[:, :half], first).argmin(axis=1) * len(second) + _squared(sample[:, half:], second).argmin(axis=1)
    counts = np.bincount(cell, minlength=len(first) * len(second))
    asked = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)
    distance = _squared(sample[asked], sample)
    distance[np.arange(len(asked)), asked] = np.inf
    nearest = np.argpartition(distance, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else np.zeros((len(asked), 1), int)
    seen = []
    for q, near in zip(asked, nearest, strict=True):
        together = _squared(sample[q : q + 1, :half], first)[0][:, None] + _squared(sample[q : q + 1, half:], second)[0][None, :]
        order = np.argsort(together.ravel(), kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(counts[order])
        seen.append(upto[cell[near]] / len(sample))
    return Codebooks(first, second, float(np.quantile(np.concatenate(seen), recall)))


def distinct_vectors(vectors: DataFrame, id_column: str, vector_column: str, keep: int) -> DataFrame:
    """(vector, ids): every distinct usable vector with its ``keep`` smallest different ids. Null ids, and vectors that are null, empty, all zero or hold null or non-finite components, are left out."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # no negative zeros
    rows = rows.distinct()
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return rows.withColumn("place", first).filter(F.col("place") <= keep).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for every usable query, by Euclidean distance in double precision.

    A query's own id is no candidate. All usable vectors have the width of most; others are left out. Fewer than k candidates: all of
    them. Repeated ids count once per different vector. Nothing usable: no rows.
    """
    found = distinct_vectors(vectors, id_column, vector_column, k + 1)
    found = materialize(found, "index-distinct")
    vectors_of_id = found.select(F.explode("ids").alias("id")).groupBy("id").count().agg(F.max("count")).first()[0] or 1
    candidates = k + min(vectors_of_id, k)
    widths = found.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width, total = widths["width"], widths["count"]
    half = max(1, width // 2)
    found = found.filter(F.size("vector") == width)
    sample = found.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toPandas()["vector"]
    books = fit(np.stack(sample.tolist()), total, k, recall)
    n_second = len(books.second)

    def cell_of(x: np.ndarray) -> np.ndarray:
        return _squared(x[:, :half], books.first).argmin(axis=1) * n_second + _squared(x[:, half:], books.second).argmin(axis=1) if half < width else _squared(x, books.first).argmin(axis=1) * n_second

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([pa.array(cell_of(matrix(part["vector"])), pa.int32()), part["vector"], part["ids"]], ["cell", "vector", "ids"])

    entries = materialize(found.mapInArrow(assign, "cell int, vector array<double>, ids array<long>"), "index-entries")
    sizes = {r["cell"]: r["count"] for r in entries.groupBy("cell").count().collect()}  # at most MOST * MOST cells
    wanted = max(LEAST_ENTRIES, int(np.ceil(books.share * total)))

    asked = queries.select(queries[id_column].cast("long").alias("query_id"), queries[vector_column].cast("array<double>").alias("vector"))
    asked = asked.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    usable = found.select(F.col("vector").alias("known"))
    asked = asked.filter(F.col("query_id").isNotNull()).join(usable, F.col("vector") == F.col("known"), "left_semi")
    asked = materialize(asked, "index-queries")
    numbered = asked.select("vector").distinct().withColumn("point", F.monotonically_increasing_id())
    points = materialize(numbered, "index-points")
    run_of, entries_of = runs_of_cells(sizes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = matrix(part["vector"])
                one = _squared(x[:, :half], books.first)
                two = _squared(x[:, half:], books.second) if half < width else np.zeros((len(x), 1))
                row, run, cells = [], [], []
                for k_, (a, b) in enumerate(zip(one, two, strict=True)):
                    held, visited = 0, defaultdict(list)
                    for i, j in cells_in_order(a, b):
                        if n := sizes.get(cell := i * n_second + j, 0):
                            visited[run_of[cell]].append(cell)
                            held += n
                            if held >= wanted:
                                break
                    row += [k_] * len(visited)
                    run += visited
                    cells += visited.values()
                of = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), part["point"].take(of), part["vector"].take(of), pa.array(cells, pa.list_(pa.int32()))], ["run", "point", "vector", "cells"])

    probes = materialize(points.mapInArrow(walk, "run int, point long, vector array<double>, cells array<int>"), "index-probes")
    asks = {r["run"]: r["count"] for r in probes.groupBy("run").count().collect()}

    # A run of many entries or many probes is dealt over blocks; every probe meets every block of its run's entries once.
    spark = vectors.sparkSession
    blocks = spark.createDataFrame([(r, max(1, -(-n // ENTRY_BLOCK)), max(1, -(-asks.get(r, 0) // QUERY_BLOCK))) for r, n in entries_of.items()], "run int, e int, q int")
    blocks = F.broadcast(blocks)
    runs = F.broadcast(spark.createDataFrame(list(run_of.items()), "cell int, run int"))
    draw = lambda n: F.pmod(F.xxhash64("vector"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(blocks, "run").select("run", "point", "vector", "cells", draw("q").alias("qb"), every("e").alias("eb"))
    right = entries.join(runs, "cell").join(blocks, "run").select("run", "cell", "vector", "ids", draw("e").alias("eb"), every("q").alias("qb"))

    def candidates_of(distance: np.ndarray, ids: pa.Array) -> Iterator[tuple[int, list[int]]]:
        """Entries of a block, with their ids, that can be among the candidates; those at one distance all stay, as ids decide between them."""
        if vectors_of_id <= k:
            last = np.partition(distance, min(candidates, len(distance)) - 1)[min(candidates, len(distance)) - 1]
            yield from ((i, ids[i].as_py()) for i in np.flatnonzero(distance <= last).tolist())
            return
        times, held, last = Counter(), 0, 0.0
        for i in np.argsort(distance, kind="stable").tolist():
            if held >= candidates and distance[i] > last:
                break
            if left := [x for x in ids[i].as_py() if times[x] < k]:
                times.update(left)
                held, last = held + len(left), distance[i]
                yield i, left

    def rank(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        points_, distances = [], []
        kept: list[list[int]] = []
        if len(asked) and len(held):
            x, y = (matrix(t["vector"].combine_chunks()) for t in (asked, held))
            number, ids = asked["point"].to_numpy(), held["ids"].combine_chunks()
            known, of_cell = np.unique(held["cell"].to_numpy(), return_inverse=True)
            cells = asked["cells"].combine_chunks()
            for at in range(0, len(x), ROWS_AT_ONCE):
                part, near, off = x[at : at + ROWS_AT_ONCE], *_roughly(x[at : at + ROWS_AT_ONCE], y)
                visited = np.zeros((len(part), len(known)), bool)
                for i in range(len(part)):
                    visited[i] = np.isin(known, cells[at + i].values.to_numpy())
                near[~visited[:, of_cell]] = np.inf
                for i, q in enumerate(part):
                    inside = visited[i][of_cell]
                    some = np.flatnonzero(inside)
                    if vectors_of_id <= k and len(some) > candidates and np.isfinite(near[i][some]).all():
                        last = np.partition(near[i], candidates - 1)[candidates - 1]
                        some = np.flatnonzero(inside & (near[i] <= last + 2 * off[i]))
                    if not len(some):
                        continue
                    distance = np.sqrt(((y[some] - q) ** 2).sum(axis=1))
                    for j, left in candidates_of(distance, ids.take(pa.array(some))):
                        points_.append(number[at + i])
                        kept.append(left)
                        distances.append(float(distance[j]))
        return pa.table({"point": pa.array(points_, pa.int64()), "ids": pa.array(kept, pa.list_(pa.int64())), "distance": pa.array(distances, pa.float64())})

    by = ["run", "eb", "qb"]
    close = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rank, "point long, ids array<long>, distance double")
    close = close.select("point", "distance", F.explode("ids").alias("id"))
    if vectors_of_id > k:
        of_id = Window.partitionBy("point", "id").orderBy("distance")
        close = close.withColumn("place", F.row_number().over(of_id)).filter(F.col("place") <= k)
    best = Window.partitionBy("point").orderBy("distance", "id")
    close = close.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= candidates)
    lists = close.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    lists = measured(materialize(lists, "index-lists"))
    named = asked.distinct().join(points, "vector").select("query_id", "point").join(lists, "point")
    named = named.select("query_id", F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k).alias("near"))
    ranked = named.select("query_id", F.posexplode("near").alias("place", "n"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.distance").alias("score"))
