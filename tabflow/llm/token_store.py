"""Token ids as seekable zstandard files: one frame a document, a trailing seek table, checksums on every frame.

A file is a sequence of zstandard frames, so any zstandard reader gives all its ids in order:

    document frame *   the ids of one document, unsigned 32-bit little-endian; its content checksum is on
    closing frame      skippable (0x184D2A50), 4 bytes of payload, after about every megabyte
    index frame        skippable (0x184D2A51): zstandard of the document ids (int64) and of their null flags (1 byte each)
    seek table         skippable (0x184D2A5E): compressed size, size and checksum (low half of XXH64) of each frame before it,
                       the number of frames, a descriptor byte and the magic number 0x8F92EAB1, as in the public seekable format

Files are written by Spark's own writer and committer, so lost or repeated tasks leave no half files on any file system that
Spark can reach: blocks of frames are rows of text, and the separator of rows is the magic number with which the file has to end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.llm.shared import documents_of, shards, text_key
from tabflow.llm.tokens import encoder
from tabflow.session import materialize

MAGIC = struct.pack("<I", 0x8F92EAB1)
CLOSING, INDEX, TABLE = 0x184D2A50, 0x184D2A51, 0x184D2A5E
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 24 << 20
ROW_SCHEMA = "doc_id long, part int, place long, n_tokens long, ids_crc32 long"


class FrameWriter:
    """Frames of one file, as blocks that each lack the four bytes of MAGIC at their end."""

    def __init__(self, level: int = 1):
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.block: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> bytes | None:
        """A full block, or None while it fills."""
        raw = ids.astype("<u4").tobytes()
        frame = self.compressor.compress(raw)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.block.append(frame)
        self.size += len(frame)
        return self._closed() if self.size >= BLOCK_BYTES else None

    def _closed(self) -> bytes:
        out = b"".join([*self.block, struct.pack("<II", CLOSING, 4)])
        self.entries.append((12, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        self.block, self.size = [], 0
        return out

    def end(self) -> bytes:
        ids = np.array([i or 0 for i in self.ids], "<i8").tobytes() + bytes(i is None for i in self.ids)
        packed = zstandard.ZstdCompressor(write_checksum=True).compress(ids)
        self.entries.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = np.array(self.entries, "<u4").tobytes()
        footer = struct.pack("<IB", len(self.entries), 0x80)
        return b"".join([*self.block, struct.pack("<II", INDEX, len(packed)), packed, struct.pack("<II", TABLE, len(table) + 9), table, footer])


class TokenFile:
    """Reads single documents of a file: the seek table and the index first, then only the frames that are asked for."""

    def __init__(self, file: BinaryIO):
        self.file = file
        size = file.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if struct.pack("<I", magic) != MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        starts = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        if starts[-1] + 8 + 12 * n + 9 != size:
            raise ValueError("the seek table does not cover the file")
        packed = self._read(int(starts[-2]) + 8, int(table[-1, 0]) - 8)
        raw = zstandard.ZstdDecompressor().decompress(packed)
        self.frames = np.flatnonzero(table[:, 1])
        ids, null = np.frombuffer(raw[: 8 * len(self.frames)], "<i8"), raw[8 * len(self.frames) :]
        self.ids = [None if z else i for i, z in zip(ids.tolist(), null, strict=True)]
        self.table, self.starts = table, starts
        self.decompressor = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        frame = int(self.frames[k])
        size, length, checksum = self.table[frame].tolist()
        raw = self.decompressor.decompress(self._read(int(self.starts[frame]), size), max_output_size=length)
        if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {frame} is damaged")
        return np.frombuffer(raw, "<u4")

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """All documents with this id; ids ascend in a file, null first."""
        return [self.document(k) for k, i in enumerate(self.ids) if i == doc_id]


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of every whole text, ``end_id`` after each, in ascending doc_id order within and across files.

    Null texts are empty texts; null ids come first; rows with one id stand in the order of their texts in a file, and in that of a hash of them
    across files. An empty table gives files without documents.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, writer, end = encoder(tokenizer), FrameWriter(), np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), known.encode(batch["text"]), strict=True):
                if (block := writer.add(doc_id, np.concatenate([ids, end]))) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])
        yield pa.RecordBatch.from_arrays([pa.array([writer.end()], pa.binary())], ["block"])

    docs = documents_of(documents)
    docs = docs.repartitionByRange(shards(documents, shard_bytes), "doc_id", text_key(F.col("text"))).sortWithinPartitions("doc_id", "text")
    blocks = docs.mapInArrow(encoded, "block binary").select(F.col("block").cast("string"))
    blocks.write.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).option("compression", "none").text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, part (file), place (ids before it in its file), n_tokens, ids_crc32.

    Every frame is decompressed by itself and held against its checksum. Null ids stay null.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch["part"].to_pylist(), batch["content"], strict=True):
                file, rows, place = TokenFile(pa.BufferReader(content.as_buffer())), [], 0
                for k, doc_id in enumerate(file.ids):
                    ids = file.document(k)
                    rows.append((doc_id, part, place, len(ids), zlib.crc32(ids)))
                    place += len(ids)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part")
    return files.select(part, "content").mapInArrow(decoded, ROW_SCHEMA)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files. The running total is one row a file."""
    rows = materialize(read_tokens(spark, path), "token-digests")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
