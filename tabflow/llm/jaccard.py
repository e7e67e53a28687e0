"""Jaccard join of word-shingle sets by PartEnum signatures, and the classes of linked documents.

Sets that link at the threshold t differ in few shingles, if their sizes are near. Sizes fall into bands, each 1/t times as wide as
its start; a set takes part under the tag of its own band and of the next, so every pair that can link shares a tag. Under a tag the domain
of shingles is cut into partitions, and each into three parts. Two sets that link differ in at most k shingles, so fewer than half of
k + 1 partitions hold two differences or more; in another, two of the three parts agree. A signature is one such pair of parts: the
hash of what the set has in them. Sets that share no signature cannot link.

    1. sets       one row a document: size and digest of its set; equal sets are one class from here on
    2. filter     a set has a partner only if enough of its shingles occur in other sets: first over a fixed share of the domain,
                  for all sets, then over the whole of it, for those that are left
    3. signatures of the sets that are left; those of one set only are dropped
    4. stars      each signature's sets are compared with the one that shares most, its lead; links join into components
    5. rest       sets of one lead in different components are compared with each other, but for pairs that sizes, the triangle
                  inequality of the Jaccard distance or their parity bitmaps rule out
    6. classes    components of all links

Related sets share up to a hundred signatures, most of them under one lead. So step 5 joins on the lead, where a pair comes once, not on
the signature. A parity bitmap tells of each of its bits whether an odd number of shingles falls on it; two bitmaps cannot differ in more
bits than the sets differ in shingles.

A signature that very many sets share needs no pairs among those that have enough other signatures: such a set meets each of its
partners there. A set whose signatures are mostly empty or that common also has the signatures of a prefix filter.
All of this is exact: filters drop only what cannot link, and every link rests on the sets themselves.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.components import components
from tabflow.llm.shared import documents_of, measured
from tabflow.llm.words import mix, shingle_sets, words
from tabflow.session import materialize

N_WORDS = 5
#: The threshold as a fraction, 75 / 100.
NUMERATOR, DENOMINATOR = 75, 100
PARTS = 3
#: Partitions beyond those that could all differ, so that enough signatures are neither empty nor common.
SLACK = 1.4
#: The filter looks at 3 of 8 parts of the domain.
LOOKED_AT, OF = 3, 8
#: Shingles of one bucket of the filter.
BUCKET_SHINGLES = 2_000_000
#: A signature of more sets than this is common.
COMMON = 64
_U = np.uint64


def _digest(shingles: np.ndarray) -> int:
    total = mix(shingles).sum(dtype=np.uint64) ^ mix(mix(shingles) + _U(len(shingles))).sum(dtype=np.uint64) << _U(1)
    return int(mix(np.array([total ^ _U(len(shingles))], np.uint64)).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for w in words(batch["text"], lower=True):
            yield batch, w.row, shingle_sets(w, n)


def set_table(documents: DataFrame, n: int = N_WORDS) -> DataFrame:
    """doc_id, n_shingles, two digests of the set and how many of its shingles the filter looks at, for every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, sets in _sets(batches, n):
            sizes = pa.array([len(s) for s in sets], pa.int64())
            one, two = pa.array([_digest(s) for s in sets], pa.int64()), pa.array([_digest(mix(s)) for s in sets], pa.int64())
            looked = pa.array([int(((s & _U(OF - 1)) < _U(LOOKED_AT)).sum()) for s in sets], pa.int64())
            columns = [batch["doc_id"].slice(row, len(sets)), sizes, one, two, looked]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "one", "two", "looked"])

    return documents_of(documents).mapInArrow(measure, "doc_id long, n_shingles long, one long, two long, looked long")


def _named_documents(n: int):
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, np.ndarray]]:
        for _, _, sets in _sets(batches, n):
            yield {_digest(s): s for s in sets if len(s)}

    return named


def _named_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            sets = (np.frombuffer(x.as_buffer(), "<u8") for x in part["shingles"])
            yield {i: s for i, s in zip(part["node"].to_pylist(), sets, strict=True) if len(s)}


def _shared_shingles(rows: DataFrame, named, buckets: int, looked: int = OF) -> DataFrame:
    """(one, shared): of a set's shingles in ``looked`` of OF parts of the domain, how many occur in sets of other names. Sets without any are left out.

    ``named`` reads the rows as sets by name, slice by slice. A shingle that several sets of a slice have is sent once, for all of
    them; so a common one costs a bucket one entry a slice.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known in named(batches):
            if not known:
                continue
            digests = np.array(list(known), np.int64)
            kept = [s[(s & _U(OF - 1)) < _U(looked)] for s in known.values()]
            shingles, owner = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(s) for s in kept])
            order = np.argsort(shingles, kind="stable")
            shingles, owner = shingles[order], owner[order]
            again = shingles[1:] == shingles[:-1]
            many = np.concatenate([[False], again]) | np.concatenate([again, [False]])
            local = np.bincount(owner[many], minlength=len(kept))
            # Of the shingles that are alone here, each with its set; of the others one, with no set.
            first = np.concatenate([[True], ~again]) if len(shingles) else np.zeros(0, bool)
            shingles, owner = shingles[first], np.where(many[first], -1, owner[first])
            bucket = (mix(shingles) % _U(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            shingles, owner, bucket = shingles[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows, payloads = [], []
            for part in np.split(np.arange(len(bucket)), cuts):
                if not len(part):
                    continue
                owners, counts = np.unique(owner[part], return_counts=True)
                names = np.where(owners < 0, 0, digests[owners])
                head = struct.pack("<qq", len(owners), int(owners[0] < 0))
                short = (mix(shingles[part] + _U(1)) >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append(int(bucket[part[0]]))
                payloads.append(head + names.astype("<i8").tobytes() + counts.astype("<i4").tobytes() + short.tobytes())
            found = np.flatnonzero(local)
            rows.append(int(digests[0] % buckets))
            payloads.append(struct.pack("<qq", -len(found), 0) + digests[found].tobytes() + local[found].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    def count(table: pa.Table) -> pa.Table:
        digests, shared, shingles, owner = [], [], [], []
        for payload in table["payload"]:
            raw = payload.as_buffer().to_pybytes()
            k, common = struct.unpack("<qq", raw[:16])
            names = np.frombuffer(raw, "<i8", abs(k), 16)
            counts = np.frombuffer(raw, "<i4", abs(k), 16 + 8 * abs(k))
            if k <= 0:
                digests.append(names)
                shared.append(counts)
                continue
            short = np.zeros((counts.sum(), 8), np.uint8)
            short[:, :5] = np.frombuffer(raw, np.uint8, offset=16 + 12 * k).reshape(-1, 5)
            shingles.append(short.view("<u8")[:, 0])
            of = np.repeat(names, counts)
            alone = np.ones(len(of), bool)
            if common:
                alone[: counts[0]] = False
            owner.append((of, alone))
        if shingles:
            whole = np.concatenate(shingles)
            of, alone = np.concatenate([o for o, _ in owner]), np.concatenate([a for _, a in owner])
            order = np.lexsort((of, whole))
            whole, of, alone = whole[order], of[order], alone[order]
            again = whole[1:] == whole[:-1]
            # Met again: under another set, or where a slice has it in several sets.
            other = again & ((of[1:] != of[:-1]) | ~alone[1:] | ~alone[:-1])
            start = np.flatnonzero(np.concatenate([[True], ~again]))
            group = np.cumsum(np.concatenate([[0], ~again]))
            hit = np.zeros(len(start), bool)
            hit[group[1:][other]] = True
            hit |= np.bincount(group, ~alone, len(start)) > 0
            met = hit[group] & alone
            # A set is counted once for a shingle, however many slices it comes from.
            met[1:] &= ~(again & (of[1:] == of[:-1]) & alone[:-1])
            names, counts = np.unique(of[met], return_counts=True)
            digests.append(names)
            shared.append(counts)
        names = np.concatenate(digests) if digests else np.zeros(0, np.int64)
        counts = np.concatenate(shared) if shared else np.zeros(0, np.int64)
        group = (mix(names.view(np.uint64)) % _U(buckets)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        parts = [p for p in np.split(order, cuts) if len(p)]
        packed = [names[p].astype("<i8").tobytes() + counts[p].astype("<i8").tobytes() for p in parts]
        return pa.table({"bucket": pa.array([int(group[p[0]]) for p in parts], pa.int32()), "payload": pa.array(packed, pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        pairs = [np.frombuffer(p.as_buffer(), "<i8").reshape(2, -1) for p in table["payload"]]
        names, place = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([p[1] for p in pairs]), len(names)).astype(np.int64)
        return pa.table({"one": pa.array(names, pa.int64()), "shared": pa.array(counts, pa.int64())})

    # Counts travel packed, a row for each pair of buckets, and each name is summed in one place.
    counted = rows.mapInArrow(spread, "bucket int, payload binary").groupBy("bucket").applyInArrow(count, "bucket int, payload binary")
    return counted.groupBy("bucket").applyInArrow(total, "one long, shared long")


def _sets_of(documents: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, shingles): the sorted sets of the documents that are nodes, as 64-bit integers."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, sets in _sets(batches, n):
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    wanted = documents_of(documents).join(measured(nodes), F.col("doc_id") == F.col("node"), "left_semi")
    return wanted.mapInArrow(collect, "node long, shingles binary")


def _that_may_link(sets: DataFrame) -> DataFrame:
    """The sets of which the threshold's share or more occurs in other sets that are left, over the whole domain."""
    size = F.octet_length("shingles") / 8
    total = sets.agg(F.sum(size)).first()[0] or 0
    shared = materialize(_shared_shingles(sets, _named_nodes, int(total / BUCKET_SHINGLES) + 1), "jaccard-shared")
    left = sets.join(measured(shared.withColumnRenamed("one", "node")), "node").filter(F.col("shared") * DENOMINATOR >= size * NUMERATOR)
    return materialize(left.select("node", "shingles"), "jaccard-shingles")


def _bands(size: int) -> list[tuple[int, int]]:
    """(tag, largest size) of the band of a size and of the next."""
    tag, low = 0, 1
    while True:
        high = low * DENOMINATOR // NUMERATOR
        if size <= high:
            return [(tag, high), (tag + 1, (high + 1) * DENOMINATOR // NUMERATOR)]
        tag, low = tag + 1, high + 1


def signatures_of(shingles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per tag: signatures, the partition of each (-1: prefix filter), and how many partitions may be lost to common signatures.

    ``spare`` is the number of partitions with three signatures beyond those that two differences or more could fill.
    """
    size = len(shingles)
    for tag, high in _bands(size):
        apart = DENOMINATOR - NUMERATOR
        if 2 * high * apart < DENOMINATOR + NUMERATOR:
            continue  # different sets of such sizes cannot link
        most = apart * 2 * high // (DENOMINATOR + NUMERATOR)
        partitions = int(np.ceil(SLACK * (most // 2 + 1))) + 1
        own = apart * (size + min(high, size * DENOMINATOR // NUMERATOR)) // (DENOMINATOR + NUMERATOR)
        seed = mix(np.array([tag], np.uint64))[0]
        part = ((mix(shingles ^ seed) >> _U(32)) * _U(partitions * PARTS) >> _U(32)).astype(np.int64)
        sums = np.zeros(partitions * PARTS, np.uint64)
        np.add.at(sums, part, mix(shingles + _U(17)))
        sums, counts = sums.reshape(-1, PARTS), np.bincount(part, minlength=partitions * PARTS).reshape(-1, PARTS)
        others, full = sums.sum(axis=1, keepdims=True) - sums, counts.sum(axis=1, keepdims=True) > counts
        name = mix(np.arange(partitions * PARTS, dtype=np.uint64) + seed).reshape(-1, PARTS)
        hashes, where = mix(others ^ name)[full], np.nonzero(full)[0]
        spare = int(full.all(axis=1).sum()) - own // 2
        yield hashes, where, spare
        if spare <= 0:
            need = -(-size * NUMERATOR // DENOMINATOR)
            prefix = np.sort(mix(shingles + _U(29)))[: size - need + 1]
            yield mix(prefix ^ mix(np.array([tag + 1], np.uint64))[0] ^ _U(1)), np.full(len(prefix), -1), 0


def signature_table(sets: DataFrame) -> DataFrame:
    """(sig, node, tag_part, spare): tag_part tells partitions of a node apart; it is -1 for the prefix filter."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch["node"].to_pylist()
            for at in range(0, len(nodes), 200):
                sig, node, part, spare = [], [], [], []
                for k in range(at, min(at + 200, len(nodes))):
                    for tag, (hashes, where, left) in enumerate(signatures_of(np.frombuffer(batch["shingles"][k].as_buffer(), "<u8"))):
                        sig.append(hashes.view(np.int64))
                        node.append(np.full(len(hashes), nodes[k], np.int64))
                        part.append(np.where(where < 0, -1, where * 4 + tag))
                        spare.append(np.full(len(hashes), left, np.int32))
                if sig:
                    columns = [pa.array(np.concatenate(x), t) for x, t in ((sig, pa.int64()), (node, pa.int64()), (part, pa.int64()), (spare, pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["sig", "node", "part", "spare"])

    return sets.mapInArrow(sign, "sig long, node long, part long, spare int")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, total): the sizes of the intersection and the union, from the sets themselves."""
    sets = measured(sets)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b").select("a", "b", "of_a", "of_b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, total = [], []
            for x, y in zip(batch["of_a"], batch["of_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                same = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                inter.append(same)
                total.append(len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(inter, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "inter", "total"])

    return both.mapInArrow(count, "a long, b long, inter long, total long")


def _linked() -> Column:
    return F.col("inter") * DENOMINATOR >= F.col("total") * NUMERATOR


#: Rounds of stars go on while the pairs that are left are more than so many a set and lead, and each round halves them.
PAIRS_A_ROW, ROUNDS = 32, 6
#: Bits of a parity bitmap for each shingle, at least.
BITS_A_SHINGLE = 2


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """As 64-bit integers, a power of two of bits: whether an odd number of shingles falls on each. Halves fold by exclusive or."""
    width = max(128, 1 << int(BITS_A_SHINGLE * len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles + _U(43)) & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def bitmap_table(sets: DataFrame) -> DataFrame:
    """(node, size, wide, half): the parity bitmap of each set, and the same folded once."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [np.frombuffer(x.as_buffer(), "<u8") for x in batch["shingles"]]
            wide = [parity_bitmap(s) for s in shingles]
            half = [w[: len(w) // 2] ^ w[len(w) // 2 :] for w in wide]
            columns = [pa.array([len(s) for s in shingles], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (wide, half))]
            yield pa.RecordBatch.from_arrays([batch["node"], *columns], ["node", "size", "wide", "half"])

    return sets.select("node", "shingles").mapInArrow(fill, "node long, size long, wide array<long>, half array<long>")


def _may_link(x: str, y: str) -> Column:
    """Whether sizes and bitmaps of two rows of ``bitmap_table`` allow a link. Widths differ by one fold at most, if the sizes allow it."""

    def apart(one: Column, two: Column) -> Column:
        bits = F.zip_with(one, two, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        return F.aggregate(bits, F.lit(0), lambda total, n: total + n)

    one, two = ({c: F.col(f"{side}.{c}") for c in ("size", "wide", "half")} for side in (x, y))
    sizes = F.least(one["size"], two["size"]) * DENOMINATOR >= F.greatest(one["size"], two["size"]) * NUMERATOR
    wider = F.size(one["wide"]) - F.size(two["wide"])
    left = F.when(wider > 0, one["half"]).otherwise(one["wide"])
    right = F.when(wider < 0, two["half"]).otherwise(two["wide"])
    return sizes & (apart(left, right) * (DENOMINATOR + NUMERATOR) <= (one["size"] + two["size"]) * (DENOMINATOR - NUMERATOR))


def _members(sets: DataFrame) -> DataFrame:
    """(sig, node, part, spare, n, kept) of the signatures that stand for a group of sets, and of the common ones (kept is false then).

    Signatures of one set only, and all but one of those that the same sets share, say nothing new and are dropped.
    """
    signed = signature_table(sets)
    digests = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(20,0)")).alias(f"d{k}") for k in (0, 1)]
    groups = signed.groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), *digests).filter("low <> high")
    groups = materialize(groups.select("sig", "n", F.xxhash64("d0", "n").alias("d0"), F.xxhash64("d1", "n").alias("d1")), "jaccard-groups")
    first = groups.groupBy("n", "d0", "d1").agg(F.min("sig").alias("sig")).select("sig", "n", F.lit(True).alias("kept"))
    wanted = first.union(groups.filter(F.col("n") > COMMON).select("sig", "n", F.lit(False))).groupBy("sig", "n").agg(F.max("kept").alias("kept"))
    return materialize(signed.join(materialize(wanted, "jaccard-wanted").hint("merge"), "sig"), "jaccard-members")


def _unsafe(members: DataFrame) -> DataFrame:
    """(node, tag) of the sets that common signatures leave too few partitions, so that they may miss a partner elsewhere."""
    common = members.filter((F.col("n") > COMMON) & (F.col("part") >= 0))
    lost = common.groupBy("node", "part").agg(F.min("spare").alias("spare")).groupBy("node", F.pmod("part", F.lit(4)).alias("tag"))
    return materialize(lost.agg(F.count("*").alias("lost"), F.min("spare").alias("spare")).filter("lost >= spare").select("node", "tag"), "jaccard-unsafe")


def _mixed(met: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components of the links, and the rows (lead, node, component) of those leads whose sets are still in several of them."""
    known = measured(materialize(components(links), "jaccard-components"))
    placed = met.select("lead", "node").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("lead").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("lead")
    return known, materialize(placed.join(measured(materialize(mixed, "jaccard-mixed")), "lead", "left_semi").select("lead", "node", "component"), "jaccard-placed")


def _between(placed: DataFrame, checked: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of sets of one lead and different components that may link.

    The largest component of a lead meets the others, and these meet each other; so the work grows with the pairs between components,
    and not with the pairs within a large one.
    """
    far = checked.select("a", "b", (1 - F.col("inter") / F.col("total")).alias("distance"))
    far = far.union(far.select("b", "a", "distance")).select(F.col("a").alias("lead"), F.col("b").alias("node"), "distance")
    wanted = materialize(placed.select("node").distinct(), "jaccard-between")
    bitmaps = measured(materialize(bitmap_table(sets.join(measured(wanted), "node", "left_semi")), "jaccard-bitmaps"))
    sizes = placed.groupBy("lead", "component").agg(F.count("*").alias("n"))
    most = materialize(sizes.groupBy("lead").agg(F.max_by("component", F.struct("n", "component")).alias("most")), "jaccard-most")
    rows = placed.join(far, ["lead", "node"]).join(measured(most), "lead").join(bitmaps, "node")
    rows = materialize(rows.withColumn("largest", F.col("component") == F.col("most")), "jaccard-distances")
    limit = 1 - NUMERATOR / DENOMINATOR + 1e-9
    others = rows.filter("not largest").alias("y")
    near = (F.col("x.lead") == F.col("y.lead")) & (F.abs(F.col("x.distance") - F.col("y.distance")) <= limit) & _may_link("x", "y")
    first = rows.filter("largest").alias("x").join(others, near)
    second = rows.filter("not largest").alias("x").join(others, near & (F.col("x.component") != F.col("y.component")) & (F.col("x.node") < F.col("y.node")))
    ends = [f(F.col("x.node"), F.col("y.node")).alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
    return first.select(ends).union(second.select(ends)).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")


def link_components(sets: DataFrame) -> DataFrame:
    """(node, component) of all nodes that link with another; ``sets`` is a written table of (node, shingles)."""
    every = _members(sets)
    members = every.filter("kept")
    # The set that shares most is the likely centre of a group: edited copies link with their origin rather than with each other.
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    heavy = members.join(measured(materialize(weight, "jaccard-weights")), "node")
    leads = heavy.groupBy("sig").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("lead"))
    # A set has one row for each of its leads and tags, however many signatures it shares with the lead.
    free = (F.col("n") <= COMMON) | (F.col("part") < 0)
    tag = F.when(F.col("part") >= 0, F.pmod("part", F.lit(4)))
    led = members.join(measured(materialize(leads, "jaccard-leads")), "sig").select("lead", "node", tag.alias("tag"), free.alias("free"))
    led = materialize(led.filter("node <> lead").groupBy("lead", "node", "tag").agg(F.max("free").alias("free")), "jaccard-led")
    pairs = led.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    checked = materialize(compare(pairs, sets), "jaccard-checked")
    # In a common signature only sets count that may miss a partner in their others.
    risky = led.filter("not free").join(measured(_unsafe(every)), ["node", "tag"], "left_semi").select("lead", "node")
    met = materialize(led.filter("free").select("lead", "node").union(risky).distinct(), "jaccard-met")
    known, placed = _mixed(met, checked.filter(_linked()).select("a", "b"))
    before = None
    for turn in range(ROUNDS + 1):
        sizes = placed.groupBy("lead", "component").agg(F.count("*").alias("n")).groupBy("lead").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
        rows, left = sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("within")) / 2)).first()
        if not left:
            return known
        if left <= PAIRS_A_ROW * rows or turn == ROUNDS or (before is not None and 2 * left > before):
            break
        before = left
        drawn = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), "node", "component")).alias("drawn")
        heads = materialize(placed.groupBy("lead").agg(drawn).select("lead", "drawn.node", "drawn.component"), "jaccard-heads")
        h, p = heads.alias("h"), placed.alias("p")
        new = p.join(h, F.col("p.lead") == F.col("h.lead")).filter("p.component <> h.component")
        new = new.select(F.least("p.node", "h.node").alias("a"), F.greatest("p.node", "h.node").alias("b")).distinct()
        new = new.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        checked = materialize(checked.unionByName(compare(new, sets)), "jaccard-checked")
        known, placed = _mixed(placed, checked.filter(_linked()).select("a", "b"))

    more = materialize(compare(_between(placed, checked, sets), sets).filter(_linked()).select("a", "b"), "jaccard-rest")
    return components(checked.filter(_linked()).select("a", "b").union(more))


def jaccard_classes(documents: DataFrame, n: int = N_WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, itself included) of every row.

    Texts without words, and null texts, have an empty set and link with nothing; so do rows without an id, whose component is
    null. Rows with one id are one document with several texts. An empty table gives no rows.
    """
    base = materialize(set_table(documents, n), "jaccard-sets")
    classes = base.filter("n_shingles > 0 and doc_id is not null").groupBy("one", "two").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("size"), F.max("looked").alias("looked"))
    classes = materialize(classes, "jaccard-classes")
    total = base.agg(F.sum("n_shingles")).first()[0] or 0
    texts, buckets = documents_of(documents).select("text"), int(total * LOOKED_AT / OF / BUCKET_SHINGLES) + 1
    shared = _shared_shingles(texts, _named_documents(n), buckets, LOOKED_AT)
    need = F.col("looked") - F.floor(F.col("size") * (DENOMINATOR - NUMERATOR) / DENOMINATOR)
    left = classes.join(shared, "one", "left").filter(F.coalesce("shared", F.lit(0)) >= need).select("node").distinct()
    sets = _that_may_link(materialize(_sets_of(documents, materialize(left, "jaccard-left"), n), "jaccard-shingles"))
    same = base.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    several = base.join(measured(materialize(same, "jaccard-repeated")), "doc_id", "left_semi").join(classes.select("one", "two", "node"), ["one", "two"])
    links = link_components(sets).select(F.col("node").alias("a"), F.col("component").alias("b")).union(several.select("doc_id", "node"))
    found = materialize(components(links), "jaccard-found")
    placed = classes.join(measured(found), "node", "left").select("one", "two", F.coalesce("component", "node").alias("component"))
    placed = measured(materialize(placed, "jaccard-placed"))
    joined = base.join(placed, ["one", "two"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def one_of_each(documents: DataFrame, n: int = N_WORDS) -> DataFrame:
    """The documents with all their columns, one of each class: the one with the smallest doc_id.

    Rows without an id all stay, as they link with nothing. Of rows with one id, the one with the smallest text stays.
    """
    classes = materialize(jaccard_classes(documents, n), "jaccard-result")
    ids = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id"))
    ids = ids.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id"), (F.col("rows") > 1).alias("repeated"))
    ids = measured(materialize(ids, "jaccard-kept"))
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("of"))
    found = rows.join(ids, F.col("id") == F.col("kept_id"))
    again = F.row_number().over(Window.partitionBy("id").orderBy("of"))
    first = found.filter("repeated").withColumn("place", again).filter("place = 1").select("row")
    kept = found.filter("not repeated").select("row").union(first).union(rows.filter("id is null").select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
