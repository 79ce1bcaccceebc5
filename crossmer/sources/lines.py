"""Text files as numbered records, in file order, without a global sort."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def numbered_records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(line_no, value) with 0-based numbers over the whole input, blanks included.

    Records of one file split are contiguous; a split starts at the number of
    records in all splits before it. Only one row per split takes part in the
    global order.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    try:
        raw = reader.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"input file not found: {path}") from error
        raise
    raw = raw.select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = raw.groupBy("_file", "_start").agg(
        F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", (
        F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.join(offsets, ["_file", "_start"]).select(
        (F.col("_id") + F.col("_shift")).alias("line_no"),
        F.regexp_replace("value", "^\ufeff", "").alias("value"))


def first_filled(spark: SparkSession, path: str, characters: int) -> tuple[int, list[str]]:
    """Number of the first line that is not blank (-1: none), and the lines from there up to a size."""
    lines = numbered_records(spark, path)
    first = lines.filter(F.trim(F.regexp_replace("value", r"\s", "")) != "").agg(F.min("line_no")).first()[0]
    if first is None:
        return -1, []
    rows = lines.filter((F.col("line_no") >= first) & (F.col("line_no") < first + characters)).select(
        "line_no", F.col("value")).orderBy("line_no").limit(characters)
    sample, size = [], 0
    for row in rows.toLocalIterator():
        sample.append(row["value"])
        size += len(row["value"]) + 1
        if size > characters:
            break
    return first, sample


def ends_quoted(line: str, quoted: bool, delimiter: str) -> bool:
    """Whether a delimited record goes on after this line, inside a quoted field."""
    if '"' not in line:
        return quoted
    at, fresh = 0, not quoted           # fresh: at the start of a field
    while at < len(line):
        if quoted:
            close = line.find('"', at)
            if close < 0:
                return True
            at = close + 1
            if line[at:at + 1] == '"':
                at += 1
                continue
            quoted, fresh = False, False
        elif fresh and line[at] == '"':
            quoted, at = True, at + 1
        else:
            after = line.find(delimiter, at)
            if after < 0:
                return False
            at, fresh = after + 1, True
    return quoted


def delimited_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(record_no, fields) of a delimited file; a quoted field may contain line breaks.

    Every split is read twice. The first pass finds for each split where it
    would end, inside a quoted field or not, whichever way it begins; one row per
    split is enough to know how each really begins and what its first record's
    number is. The second pass numbers the records. Only lines of records with
    line breaks are grouped.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for value, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = found.setdefault((file, start), [0, False, True, 0, 0])
                own[0] += 1
                for way in (0, 1):
                    own[3 + way] += not own[1 + way]
                    own[1 + way] = ends_quoted(value, own[1 + way], delimiter)
        rows = [(*key, *own) for key, own in found.items()]
        names = ("file", "start", "lines", "end0", "end1", "records0", "records1")
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=pa.schema([
            ("file", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("end0", pa.bool_()),
            ("end1", pa.bool_()), ("records0", pa.int64()), ("records1", pa.int64())]))

    splits = raw.mapInArrow(
        summary, "file string, start long, lines long, end0 boolean, end1 boolean, records0 long, records1 long")
    begins: dict[tuple, tuple] = {}
    line, record, quoted, current = 0, 0, False, None
    for row in sorted(splits.collect(), key=lambda r: (r["file"], r["start"])):     # a row per split
        if row["file"] != current:
            current, quoted = row["file"], False
        begins[row["file"], row["start"]] = (quoted, line, record)
        line += row["lines"]
        record += row["records1"] if quoted else row["records0"]
        quoted = row["end1"] if quoted else row["end0"]
    known = spark.sparkContext.broadcast(begins)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list] = {}
        for batch in batches:
            rows = []
            for value, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = state.setdefault((file, start), list(known.value[file, start]))
                inside = own[0]
                own[2] += not inside
                own[0] = ends_quoted(value, inside, delimiter)
                rows.append((own[2] - 1, own[1], value.removeprefix("\ufeff"), not inside and not own[0]))
                own[1] += 1
            yield pa.RecordBatch.from_pydict(
                {n: [r[i] for r in rows] for i, n in enumerate(("record_no", "line_no", "value", "whole"))},
                schema=pa.schema([("record_no", pa.int64()), ("line_no", pa.int64()), ("value", pa.string()), ("whole", pa.bool_())]))

    lines = raw.mapInArrow(number, "record_no long, line_no long, value string, whole boolean")
    broken = lines.filter("NOT whole").groupBy("record_no").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "value")))["value"], "\n").alias("value"))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [next(csv.reader(io.StringIO(v, newline=""), delimiter=delimiter), []) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fields, pa.list_(pa.string()))], ["record_no", "fields"])

    records = lines.filter("whole").select("record_no", "value").unionByName(broken)
    return records.mapInArrow(parse, "record_no long, fields array<string>")
