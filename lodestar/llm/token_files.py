"""Token-ID files: one independent zstandard frame a document, and a trailing seek table.

A shard holds documents in ascending id order. Each document is one frame of its token ids
(little-endian unsigned 32-bit, end id included). Two skippable frames follow: the documents'
ids and which of them are null, and a seek table in the public zstd seekable format, which gives each frame's compressed
and decompressed size and the low 32 bits of its XXH64. A reader seeks to the frames it wants.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, scope, written
from .units import shared_library_encoder, slices

#: Fixed values of the zstd seekable format.
SKIPPABLE, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
DOC_IDS = 0x184D2A5D
#: Bytes of ids after which a task begins its next shard, and that a reader holds at once, about.
SHARD_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Tasks of a reader, at most; beyond that a task reads several shards.
READ_TASKS = 20_000


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes frames to a temporary name; close() adds the tables and renames the file."""

    def __init__(self, path: str, attempt: int, level: int = 3):
        self.fs, self.path = open_fs(path)
        self.temp = f"{self.path}.{attempt}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.zstd, self.entries, self.ids, self.size = zstandard.ZstdCompressor(level=level, write_checksum=True), [], [], 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.size += len(raw)

    def close(self) -> None:
        null = np.array([i is None for i in self.ids], bool)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        ids = zstandard.ZstdCompressor().compress(ids.tobytes() + np.packbits(null).tobytes())
        table = np.array(self.entries, "<u4").reshape(-1, 3).tobytes()
        self.out.write(struct.pack("<II", DOC_IDS, len(ids)) + ids)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEK_MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class ShardReader:
    def __init__(self, path: str):
        filesystem, self.path = open_fs(path)
        self.file = filesystem.open_input_file(self.path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        at = size - 9 - 12 * count
        self.table = np.frombuffer(self.file.read_at(12 * count, at), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        kind, n = struct.unpack("<II", self.file.read_at(8, int(self.offsets[-1])))
        if kind != DOC_IDS:
            raise ValueError(f"{path} has no table of document ids")
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(n, int(self.offsets[-1]) + 8))
        self.ids = np.frombuffer(raw, "<i8", count)
        self.null = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8 * count), count=count).astype(bool)
        self.n_tokens = self.table[:, 1] // 4

    def frames(self, first: int, stop: int) -> Iterator[bytes]:
        """The raw ids of documents first .. stop, checked."""
        base = int(self.offsets[first])
        held = self.file.read_at(int(self.offsets[stop]) - base, base)
        unzip = zstandard.ZstdDecompressor()
        for k in range(first, stop):
            raw = unzip.decompress(held[self.offsets[k] - base : self.offsets[k + 1] - base])
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"{self.path}: frame {k} is damaged")
            yield raw

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each document of that id; only its frames are read and decompressed."""
        nulls = int(self.null.sum())  # they come first
        a, b = (nulls + int(np.searchsorted(self.ids[nulls:], doc_id, side)) for side in ("left", "right"))
        return [np.frombuffer(x, "<u4") for k in range(a, b) for x in self.frames(k, k + 1)]


def write_token_files(docs: DataFrame, tokenizer_path: str, to: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents; returns the manifest (shard, path, n_docs, n_tokens, base).

    base is the number of ids in all shards before. Documents are range-partitioned by id. A task
    streams its rows to shards of about SHARD_BYTES, so shards follow the bytes whatever the number of
    partitions is; a retried task replaces its own files. Null
    texts are empty (one end id); null ids sort first; rows that repeat an id are all kept, in
    the order of their texts; an empty table gives an empty manifest. Extra columns are ignored.
    """
    spark = docs.sparkSession
    to = (to or new_path(spark, "tokens")).rstrip("/")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, context, turn = None, TaskContext.get(), 0

        def done() -> pa.RecordBatch:
            writer.close()
            shard = context.partitionId() * 1_000_000 + turn
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [f"{to}/{name}"], "n_docs": [len(writer.ids)], "n_tokens": [writer.size // 4]})

        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, ends = shared_library_encoder(tokenizer_path)(texts)
                raw = ids.astype("<u4").tobytes()
                for doc_id, a, b in zip(batch.column(0).slice(at, len(texts)).to_pylist(), (4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist()):
                    if writer is None:
                        name = f"part-{context.partitionId():06d}-{turn:06d}.zst"
                        writer = ShardWriter(f"{to}/{name}", context.taskAttemptId())
                    writer.add(doc_id, raw[a:b] + end)
                    if writer.size >= SHARD_BYTES:
                        yield done()
                        writer, turn = None, turn + 1
        if writer is not None:
            yield done()

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with scope() as held:
        manifest = written(sorted_rows.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_tokens bigint"), "manifest")
        held.keep(manifest)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Each document from the files: doc_id, start, n_tokens, ids_crc32. A shard is a task, up to READ_TASKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(path)
                starts = base + np.cumsum(reader.n_tokens) - reader.n_tokens
                at, n = 0, len(reader.ids)
                while at < n:
                    stop = max(at + 1, int(np.searchsorted(reader.offsets, reader.offsets[at] + READ_BYTES)) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.ids[at:stop], mask=reader.null[at:stop]), pa.array(starts[at:stop]), pa.array(reader.n_tokens[at:stop]), pa.array([zlib.crc32(x) for x in reader.frames(at, stop)], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = stop

    tasks = max(1, min(READ_TASKS, manifest.count()))  # given, or the small manifest would be read by one task
    return manifest.select("path", "base").repartition(tasks).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
