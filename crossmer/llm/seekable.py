"""Token-id files of independent zstandard frames with a trailing seek table (operator 1).

A file holds one frame per document (its ids as little-endian unsigned 32-bit
integers), a skippable frame with the documents' numbers, and the seek table of
the public zstandard seekable format: compressed size, content size and the low
32 bits of XXH64 of the content for every frame. A reader takes the tail of the
file, then only the frames it wants. Any zstandard tool can decompress the file.

Files lie in the shared folder and are written and read through pyarrow's file
systems. A row of the manifest names a file only if its task succeeded; files of
lost attempts are never named.

Cases: null and empty texts are a document with the end id alone; equal or null
doc_ids stay separate documents, nulls first, ties by text; an empty table has an
empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from crossmer.llm.common import pieces, table
from crossmer.llm.tokens import END_ID, default_tokenizer, encoder
from crossmer.operators.storage import materialize, new_path

SEEK_TABLE_MAGIC = 0x184D2A5E
DOCUMENTS_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("compressed", "<u4"), ("content", "<u4"), ("checksum", "<u4")])
NO_ID = -(1 << 63)       # stands for a null doc_id in a file
READ_BYTES = 16 << 20


class DamagedFrame(ValueError):
    """A frame's content does not have the checksum of the seek table."""


def open_system(path: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FrameWriter:
    """Appends documents to one file; close() adds the documents' numbers and the seek table."""

    def __init__(self, path: str, level: int = 3):
        import zstandard

        system, inner = open_system(path)
        system.create_dir(os.path.dirname(inner), recursive=True)
        self._out = system.open_output_stream(inner, compression=None)
        self._compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self._entries: list[tuple[int, int, int]] = []
        self._documents: list[int] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self._compress(ids)
        self._out.write(frame)
        self._entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self._documents.append(NO_ID if doc_id is None else doc_id)
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        numbers = np.array(self._documents, dtype="<i8").tobytes()
        self._out.write(struct.pack("<II", DOCUMENTS_MAGIC, len(numbers)) + numbers)
        entries = np.array(self._entries, dtype=ENTRY).tobytes()
        self._out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(entries) + FOOTER.size) + entries)
        self._out.write(FOOTER.pack(len(self._entries), WITH_CHECKSUMS, SEEKABLE_MAGIC))
        self._out.close()


class FrameReader:
    """Reads the seek table, then any frames by number, touching no other bytes."""

    def __init__(self, path: str):
        import zstandard

        system, inner = open_system(path)
        self._in = system.open_input_file(inner)
        size = self._in.size()
        self._in.seek(size - FOOTER.size)
        count, flags, magic = FOOTER.unpack(self._in.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise DamagedFrame(f"{path} ends in no seek table")
        tail = count * (ENTRY.itemsize + 8) + FOOTER.size + 8
        self._in.seek(size - tail)
        data = self._in.read(tail)
        self.documents = np.frombuffer(data, "<i8", count)
        self.entries = np.frombuffer(data, ENTRY, count, offset=8 * count + 8)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["compressed"].astype(np.int64))])
        self._expand = zstandard.ZstdDecompressor().decompress

    def frame(self, k: int) -> bytes:
        return self.frames(k, k + 1)[0]

    def frames(self, first: int, last: int) -> list[bytes]:
        """Contents of frames first to last - 1, read in one piece and checked."""
        import xxhash

        base = int(self.starts[first])
        self._in.seek(base)
        data = memoryview(self._in.read(int(self.starts[last]) - base))
        out = []
        for k in range(first, last):
            content = self._expand(data[self.starts[k] - base:self.starts[k + 1] - base])
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.entries["checksum"][k]):
                raise DamagedFrame(f"frame {k} has another checksum")
            out.append(content)
        return out

    def runs(self, limit: int = READ_BYTES) -> Iterator[tuple[int, list[bytes]]]:
        """All frames in order, in runs of about `limit` bytes of content."""
        first, count = 0, len(self.entries)
        ends = np.cumsum(self.entries["content"].astype(np.int64))
        while first < count:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield first, self.frames(first, last)
            first = last

    def close(self) -> None:
        self._in.close()


MANIFEST = "file string, first_id long, n_docs long, n_ids long"


def write_token_files(documents: DataFrame, folder: str, tokenizer: str | None = None, *,
                      id_column: str = "doc_id", text_column: str = "text",
                      end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents in ascending id order, one file per range; returns the manifest.

    The ranges come from Spark's range partitioning, so that no task holds more
    than its share; texts stream through a task and only a frame is in memory.
    """
    path = tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)
    ordered = (
        documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        .repartitionByRange(_ranges(documents.sparkSession), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, file, first = encoder(path).encode, None, "", None
        n_docs = 0
        for batch in pieces(batches, "text"):
            numbers, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if writer is None:
                file, first = f"{folder}/ids-{uuid.uuid4().hex}.zst", numbers[0]
                writer = FrameWriter(file)
            for number, ids in zip(numbers, encode(texts), strict=True):
                writer.add(number, ids + end)
            n_docs += len(numbers)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([first], pa.int64()), pa.array([n_docs], pa.int64()),
                 pa.array([writer.n_ids], pa.int64())], ["file", "first_id", "n_docs", "n_ids"])

    return materialize(ordered.mapInArrow(write, MANIFEST))


def _ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the ids in all files before; it has a row per file, not per document."""
    before = W.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of int) of every document, read back from the files."""
    return _read(manifest, "ids array<long>", lambda content: np.frombuffer(content, "<u4").tolist(), pa.list_(pa.int64()))


def read_documents(manifest: DataFrame, wanted: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id and ids of the wanted documents; only their frames are decompressed.

    The wanted numbers meet the files by their first ids, as the range of each
    file is known from the manifest.
    """
    files = manifest.withColumn("next_id", F.lead("first_id").over(W.orderBy(F.col("first_id").asc_nulls_first())))
    asked = wanted.select(F.col(id_column).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    inside = (F.coalesce(F.col("first_id"), F.lit(NO_ID)) <= F.col("doc_id")) & (
        F.col("next_id").isNull() | (F.col("doc_id") < F.col("next_id")))
    by_file = asked.join(F.broadcast(files.select("file", "first_id", "next_id")), inside).select("file", "doc_id")

    def fetch(key, frame):
        reader = FrameReader(key[0].as_py())
        picked = np.flatnonzero(np.isin(reader.documents, frame.column("doc_id").to_numpy()))
        contents = [np.frombuffer(reader.frame(int(k)), "<u4").tolist() for k in picked]
        reader.close()
        return pa.table({"doc_id": pa.array(reader.documents[picked]), "ids": pa.array(contents, pa.list_(pa.int64()))})

    return by_file.groupBy("file").applyInArrow(fetch, "doc_id long, ids array<long>")


def _read(manifest: DataFrame, column: str, value, kind: pa.DataType) -> DataFrame:
    name = column.split(" ")[0]
    files = file_starts(manifest).select("file", "start")
    files = files.repartition(_ranges(manifest.sparkSession))     # a file is a task's worth of work

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = FrameReader(file)
                for first, contents in reader.runs():
                    numbers = reader.documents[first:first + len(contents)]
                    lengths = np.array([len(c) // 4 for c in contents], dtype=np.int64)
                    starts = start + np.concatenate([[0], np.cumsum(lengths)])
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers.astype(np.int64), mask=numbers == NO_ID), pa.array(starts[:-1]),
                         pa.array(lengths), pa.array([value(c) for c in contents], kind)],
                        ["doc_id", "start", "n_tokens", name])
                reader.close()

    return files.mapInArrow(read, f"doc_id long, start long, n_tokens long, {column}")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids of every document, read back from the files."""
    return _read(manifest, "ids_crc32 long", zlib.crc32, pa.int64())


def op1_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    target = new_path(spark, "token-ids")
    manifest = write_token_files(table(spark, folder, "documents"), target)
    return read_digests(manifest)
