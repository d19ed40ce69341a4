"""Operator 4: token ids in independent zstandard frames with a seek table.

A shard file holds, one after the other: data frames of little-endian unsigned 32-bit ids, each compressed on its own
and cut at the end of a document (a longer document fills several frames); a skippable frame with the document index
(compressed); and a skippable frame with the seek table: for every frame its compressed size, its size, and the lower
32 bits of the XXH64 of its contents, then the number of frames, a descriptor and the seekable magic number, as in the
public seekable format.  A reader finds the table from the end of the file and decompresses the frames it needs.

Documents are dealt by ranges of (doc_id, hash of the text), so shards follow each other in the order of ids and many
texts under one id, or under none, are no hot shard.  A task closes a shard once its ids and index reach `shard_bytes` (a longer
document fills its own) and begins the next; the manifest holds where each shard starts and its first and last id.
Files of failed attempts are in no manifest.  `read_documents` opens only shards whose range holds a wanted id, and
decompresses only the frames that such documents lie in.

Defined results: null text is an empty document (its end id only); rows repeated or with the same id lie next to each
other, ordered by the hash of the text, then the text; a null doc_id comes first; an empty table gives no shard; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import in_parts, materialize, open_input, open_output, shared_dir, tidy
from .tokens import BYTES, END_ID, ROWS, default_path, word_encoder

FRAME_BYTES = 256 * 1024
#: Bytes of ids and of their index in a shard, about.
SHARD_BYTES = 128 * 1024 * 1024
LEVEL = 3
#: Shard files that one reading task takes, about.
FILES_A_TASK = 8
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
MANIFEST = "shard int, part int, path string, documents long, tokens long, first_id long, last_id long"
SHARD = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
#: Stands for a null doc_id in the files.
NULL_ID = -(1 << 63)


class FrameError(ValueError):
    """The file breaks the format or a checksum."""


class TokenFileWriter:
    def __init__(self, stream, frame_bytes: int = FRAME_BYTES) -> None:
        self.stream, self.most = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.ids, self.sizes = array("q"), array("q")
        self.buffer: list[bytes] = []
        self.held = self.tokens = 0

    def _frame(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.stream.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        data = b"".join(self.buffer)
        for at in range(0, len(data), self.most):
            self._frame(data[at : at + self.most])
        self.buffer, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.most:
            self._flush()
        self.buffer.append(ids)
        self.held += len(ids)
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids) // 4)
        self.tokens += len(ids) // 4

    @property
    def size(self) -> int:
        """Bytes of all ids and of their index."""
        return 4 * self.tokens + 16 * len(self.ids)

    def close(self) -> None:
        self._flush()
        index = self.packer.compress(b"".join(np.asarray(x, "<i8").tobytes() for x in (self.ids, self.sizes)))
        self.stream.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        self.frames.append((8 + len(index), 0, 0))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.stream.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)
        self.stream.close()


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, stream) -> None:
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(max(0, size - 9))
        tail = stream.read(9)
        if len(tail) < 9 or struct.unpack("<I", tail[5:])[0] != SEEKABLE or tail[4] != 0x80:
            raise FrameError("no seek table at the end")
        n = struct.unpack("<I", tail[:4])[0]
        stream.seek(size - 9 - 12 * n - 8)
        magic, length = struct.unpack("<II", stream.read(8))
        if magic != SEEK_TABLE or length != 12 * n + 9:
            raise FrameError("the seek table is damaged")
        self.table = np.frombuffer(stream.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.r_[0, self.table[:, 0].cumsum()]
        self.unpacker = zstandard.ZstdDecompressor()
        stream.seek(int(self.at[n - 1]) + 8)
        self.ids, self.sizes = np.frombuffer(self.unpacker.decompress(stream.read(int(self.table[n - 1, 0]) - 8)), "<i8").reshape(2, -1)
        self.starts = np.r_[0, self.sizes.cumsum()]
        self.edges = np.r_[0, self.table[:-1, 1].cumsum()] // 4  # first token of each frame
        self.last: tuple[int, bytes] = (-1, b"")
        self.unpacked = 0

    def frame(self, k: int) -> bytes:
        """The contents of one frame, checked against its checksum."""
        if self.last[0] != k:
            self.stream.seek(int(self.at[k]))
            data = self.unpacker.decompress(self.stream.read(int(self.table[k, 0])))
            if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
                raise FrameError(f"frame {k} fails its checksum")
            self.last = (k, data)
            self.unpacked += 1
        return self.last[1]

    def tokens(self, row: int) -> bytes:
        """Ids of the document in a row of the index; only its frames are decompressed."""
        lo, hi = int(self.starts[row]), int(self.starts[row + 1])
        out, k = [], int(np.searchsorted(self.edges, lo, "right")) - 1
        while lo < hi:
            base = int(self.edges[k])
            upto = min(hi, int(self.edges[k + 1]))
            if upto > lo:
                out.append(self.frame(k)[4 * (lo - base) : 4 * (upto - base)])
            lo, k = max(lo, upto), k + 1
        return b"".join(out)


def write_tokens(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES, shard_bytes: int = SHARD_BYTES, directory: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text) into shard files; returns the manifest (shard, part, path, documents, tokens, first_id, last_id, start)."""
    base = directory or shared_dir(docs.sparkSession, "tokens")
    path = tokenizer or default_path()
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, name, part, task = word_encoder(path, end_id), None, "", 0, TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            out.close()
            row = (task, part, name, len(out.ids), out.tokens, out.ids[0], out.ids[-1])
            return pa.RecordBatch.from_pylist([dict(zip(SHARD.names, row, strict=True))], schema=SHARD)

        for batch in in_parts(tidy(batches), ROWS, "text", BYTES):
            ids, edge = encoder.encode_column(batch.column(1))
            for doc_id, lo, hi in zip(batch.column(0).to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if out is not None and out.size + 4 * (hi - lo) + 16 > shard_bytes:
                    yield closed()
                    out, part = None, part + 1
                if out is None:
                    name = f"{base}/{task:06d}-{part:06d}-{uuid.uuid4().hex}.tokens.zst"
                    out = TokenFileWriter(open_output(name), frame_bytes)
                out.add(doc_id, ids[lo:hi].tobytes())
        if out is not None:
            yield closed()

    shards = materialize(dealt.mapInArrow(write, MANIFEST), "tokens-manifest", one_file=True)
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard file
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    files = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_input(path) as stream:
                    f = TokenFile(stream)
                    for lo in range(0, len(f.ids), 10_000):
                        rows = range(lo, min(lo + 10_000, len(f.ids)))
                        crc = [zlib.crc32(f.tokens(i)) for i in rows]
                        ids = [None if x == NULL_ID else int(x) for x in f.ids[lo : lo + 10_000]]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(f.starts[rows.start : rows.stop] + start, pa.int64()), pa.array(f.sizes[rows.start : rows.stop], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "start").repartition(max(1, -(-files // FILES_A_TASK))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, start, ids) of the documents with one of the given ids; ids are little-endian unsigned 32-bit integers."""
    wanted = np.unique(np.array([NULL_ID if x is None else x for x in doc_ids], np.int64))
    held = spark.sparkContext.broadcast(wanted)  # the caller's list

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = held.value
        for batch in batches:
            for path, start, first, last in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                here = ask[np.searchsorted(ask, first) : np.searchsorted(ask, last, "right")]
                if not len(here):
                    continue
                with open_input(path) as stream:
                    f = TokenFile(stream)
                    for row in np.flatnonzero(np.isin(f.ids, here)).tolist():
                        doc_id = None if f.ids[row] == NULL_ID else int(f.ids[row])
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([int(f.starts[row]) + start], pa.int64()), pa.array([f.tokens(row)], pa.binary())], names=["doc_id", "start", "ids"])

    files = manifest.select("path", "start", "first_id", "last_id")
    return files.repartition(max(1, -(-manifest.count() // FILES_A_TASK))).mapInArrow(read, "doc_id long, start long, ids binary")
