"""Quartile bucket digests of texts and a bounded difference score (operator 7).

Byte triplets at small distances (the OFFSETS) are hashed into BUCKETS counters.
A bucket's code is its quartile among all counters (0 to 3), so the digest depends
on which triplets are frequent in this text rather than on their numbers. The
fingerprint is a hex string: a check byte, the length on a logarithmic scale (two
bytes), then two bits per bucket.

Likeness is 1 less the difference of two digests over the difference expected of
unrelated ones, not below 0: the codes of unrelated texts differ by 5/4 per bucket
on average, and a different length adds at most LENGTH_WEIGHT buckets' worth. Equal
digests have likeness 1; the check byte separates short texts only.

Cases: null and empty texts, and texts shorter than a triplet, have a digest with
all counters 0; equal texts have equal digests; texts of any length need the same
memory; repeated rows and equal doc_ids each stay (ordered by id, then text, nulls
first), an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crossmer.llm.common import pieces, table
from crossmer.operators.storage import materialize

BUCKETS = 256
OFFSETS = ((0, 1, 4), (0, 2, 5), (0, 3, 7))     # distances of the bytes of a triplet
LENGTH_WEIGHT = 16
UNRELATED = 1.25        # expected |difference| of two independent codes 0 to 3
HEAD_BYTES = 3
_PART = 1 << 20

_random = np.random.default_rng(20240229)
_TABLES = _random.integers(0, BUCKETS, (len(OFFSETS), 3, 256), dtype=np.uint8)


def bucket_counts(raw: bytes) -> np.ndarray:
    """How many hashed triplets of a text fall into each bucket; long texts are counted part by part."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)
    for start in range(0, len(data), _PART):
        for (a, b, c), (ta, tb, tc) in zip(OFFSETS, _TABLES, strict=True):
            stop = min(start + _PART, len(data) - c)
            if stop > start:
                hashed = ta[data[start + a:stop + a]] ^ tb[data[start + b:stop + b]]
                hashed ^= tc[data[start + c:stop + c]]
                counts += np.bincount(hashed, minlength=BUCKETS)
    return counts


def digest(raw: bytes) -> str:
    counts = bucket_counts(raw)
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(65535, int(round(256 * np.log2(len(raw) + 1))))
    check = hashlib.sha256(raw).digest()[0] if len(raw) < 64 else 0
    return (bytes([check, length >> 8, length & 255]) + packed.astype(np.uint8).tobytes()).hex()


def _codes(fingerprints: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint8).reshape(len(fingerprints), -1)
    body = data[:, HEAD_BYTES:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3
    return data[:, :HEAD_BYTES].astype(np.int64), body.reshape(len(fingerprints), -1).astype(np.int16)


def likeness(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Likeness (0 to 1) of each pair of fingerprints."""
    if not len(left):
        return np.empty(0)
    (head_a, a), (head_b, b) = _codes(left), _codes(right)
    apart = np.abs(a - b).sum(axis=1).astype(float)
    octaves = np.abs((head_a[:, 1] - head_b[:, 1]) * 256 + head_a[:, 2] - head_b[:, 2]) / 256
    apart += LENGTH_WEIGHT * UNRELATED * np.minimum(octaves / 4, 1)
    apart += head_a[:, 0] != head_b[:, 0]
    return np.maximum(0.0, 1 - apart / (UNRELATED * BUCKETS))


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text."""
    def run(batches):
        for batch in pieces(batches, "text"):
            found = [digest((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    columns = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return columns.mapInArrow(run, "doc_id long, fingerprint string")


# --- texts against their edited forms and their successors -----------------------------

RANGE_CHARS = 64     # of a text tell the ranges of one doc_id apart; Spark samples range keys, so they stay small
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_ROW = pa.schema([
    ("place", pa.string()), ("part", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text's first."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _compare(numbers: list, texts: list[str], marks: list[str]) -> dict[str, list]:
    """Rows of all texts but the last, each with the one after it."""
    changed = [edited(t, u).encode("utf-8", "surrogatepass") for t, u in zip(texts, texts[1:])]
    changed_marks = [digest(c) for c in changed]
    return {
        "doc_id": numbers[:-1], "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": marks[:-1], "edited_fingerprint": changed_marks,
        "near_edited": likeness(marks[:-1], changed_marks), "near_next": likeness(marks[:-1], marks[1:]),
    }


def with_edited_and_next(documents: DataFrame) -> DataFrame:
    """Every text with its edited form and the next text in ascending doc_id (after the last: the first).

    Texts are range partitioned and sorted once. A task compares neighbours inside
    its range and passes on its first and last text; those, two rows per range,
    are joined in a second small step. Rows of one doc_id, or without any, are dealt
    to ranges by how their texts start (the sort within a range compares whole texts),
    so a hot id is no single task unless its texts start alike.
    """
    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                            F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last: tuple | None = None
        for batch in pieces(batches, "text"):
            numbers, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            marks = [digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            if last is None:
                yield _ends("first", part, numbers[0], texts[0])
            else:
                numbers, texts, marks = [last[0], *numbers], [last[1], *texts], [last[2], *marks]
            rows = _compare(numbers, texts, marks)
            n = len(rows["doc_id"])
            yield pa.RecordBatch.from_pydict({"place": ["inside"] * n, "part": [part] * n, "text": [None] * n, **rows}, schema=_ROW)
            last = (numbers[-1], texts[-1], marks[-1])
        if last is not None:
            yield _ends("last", part, last[0], last[1])

    found = materialize(ordered.mapInArrow(run, f"place string, part long, text string, {RESULT}"))
    inside = found.filter("place = 'inside'").drop("place", "part", "text")
    return inside.unionByName(_across(found))


def _ends(place: str, part: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    row = {name: [None] for name in _ROW.names} | {"place": [place], "part": [part], "doc_id": [doc_id], "text": [text]}
    return pa.RecordBatch.from_pydict(row, schema=_ROW)


def _across(found: DataFrame) -> DataFrame:
    """The last text of each range with the first text of the next range that has any."""
    from pyspark.sql import Window as W

    ends = found.filter("place <> 'inside'")
    order = W.orderBy("part")       # ids of ranges: a row each
    parts = ends.select("part").distinct().select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(W.partitionBy())).alias("after"))
    pairs = (
        ends.filter("place = 'last'").select("part", "doc_id", "text").join(parts, "part")
        .join(ends.filter("place = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following")), "after")
        .select("doc_id", "text", "following")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _ROW if f.name not in ("place", "part", "text")]
        for batch in pieces(batches, "text"):
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                marks = [digest(t.encode("utf-8", "surrogatepass")) for t in (text, following)]
                rows = _compare([doc_id, None], [text, following], marks)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([_ROW.field(n) for n in names]))

    return pairs.mapInArrow(run, RESULT)


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return with_edited_and_next(table(spark, folder, "documents"))
