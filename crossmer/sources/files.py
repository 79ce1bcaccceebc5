"""CSV, TSV and FASTA antigen files."""

from __future__ import annotations

import csv
import os
import sys
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from crossmer import constants as C
from crossmer.functions.sequence import clean_sequence
from crossmer.operators.loading import clean_records, load_counters, unique_ids
from crossmer.sources.lines import delimited_records, first_filled, numbered_records

_SAMPLE = 8192


def detect_columns(headers: Sequence[str]) -> tuple[int, int]:
    """Positions of the id and the sequence column, by name or, for two columns, by order."""
    names = [h.strip().lower() for h in headers]
    first = lambda known: next((i for i, n in enumerate(names) if n in known), None)
    found = first(C.ID_COLUMNS), first(C.SEQUENCE_COLUMNS)
    if found == (None, None) and len(names) == 2:
        return 0, 1
    if None in found:
        raise ValueError(
            f"Could not detect ID and sequence columns from headers: {list(headers)}; "
            "name both columns explicitly")
    return found


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    return _sniff(first_filled(spark, path, _SAMPLE)[1])


def _sniff(sample: list[str]) -> str:
    if not sample:
        return ","
    try:
        guess = csv.Sniffer().sniff("\n".join(sample), delimiters="".join(C.DELIMITERS)).delimiter
        if guess in C.DELIMITERS:
            return guess
    except csv.Error:
        pass
    best = max(C.DELIMITERS, key=sample[0].count)
    return best if best in sample[0] else ","


def _csv_rows(spark, path, id_col, seq_col, delimiter) -> DataFrame | None:
    """(row_num, id, raw, blank) of every record with enough fields; None if empty.

    ``row_num`` counts records after the header from 2, blank ones included.
    """
    start, sample = first_filled(spark, path, _SAMPLE)
    if start < 0:
        return None
    delimiter = delimiter or _sniff(sample)
    headers = next(csv.reader(sample, delimiter=delimiter))
    if id_col and seq_col:
        names = [h.strip().lower() for h in headers]
        missing = [c for c in (id_col, seq_col) if c.lower() not in names]
        if missing:
            raise ValueError(f"no column {missing[0]!r} among {headers}: it was not found")
        id_at, seq_at = names.index(id_col.lower()), names.index(seq_col.lower())
    else:
        id_at, seq_at = detect_columns(headers)

    # blank lines before the header are one record each, so the header has its line's number
    body = delimited_records(spark, path, delimiter).filter(F.col("record_no") > start)
    blank = ~F.exists("fields", lambda f: F.trim(F.regexp_replace(f, r"\s", "")) != "")
    return body.filter(F.size("fields") > max(id_at, seq_at)).select(
        (F.col("record_no") - start + 1).alias("row_num"), F.get("fields", F.lit(id_at)).alias("id"),
        F.get("fields", F.lit(seq_at)).alias("raw"), blank.alias("blank"))


def _finish(cleaned: DataFrame, suffix: str, path: str, verbose: bool) -> DataFrame:
    records = unique_ids(cleaned.filter("valid").drop("valid"), suffix)
    if verbose:
        counts = load_counters(cleaned).first()
        print(f"  sequences kept: {counts['loaded']:,}")
        if counts["skipped"]:
            print(f"  records without a usable sequence: {counts['skipped']:,}")
        if counts["renamed"]:
            print(f"  ids given a suffix: {counts['renamed']:,}")
        if not counts["loaded"]:
            sys.stderr.write(f"{path}: no valid sequences\n")
    return records.select(F.col("row_num").alias("ordinal"), "id", "sequence")


def _no_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "ordinal bigint, id string, sequence string")


def load_csv(spark: SparkSession, path: str, id_col: str | None = None,
             seq_col: str | None = None, delimiter: str | None = None,
             min_len: int = C.MIN_SEQUENCE_LENGTH, max_len: int | None = None,
             verbose: bool = True) -> DataFrame:
    """(ordinal, id, sequence) of a delimited file.

    Quoted fields may contain delimiters and line breaks; a large file is read in
    parallel with exact row numbers all the same.
    """
    rows = _csv_rows(spark, path, id_col, seq_col, delimiter)
    if rows is None:
        if verbose:
            print("  nothing but blank lines")
        return _no_records(spark)
    kept = rows.filter(~F.col("blank")).drop("blank")
    return _finish(clean_records(kept, min_len, max_len), "row", path, verbose)


def iter_csv(spark: SparkSession, path: str, id_col: str | None = None,
             seq_col: str | None = None, delimiter: str | None = None) -> Iterator[tuple[str, str]]:
    """(id, cleaned sequence) one partition at a time, neither validated nor renamed."""
    rows = _csv_rows(spark, path, id_col, seq_col, delimiter)
    if rows is None:
        return
    plain = rows.select(
        "row_num", F.trim(F.coalesce("id", F.lit(""))).alias("id"),
        clean_sequence(F.coalesce("raw", F.lit(""))).alias("sequence")).orderBy("row_num")
    for row in plain.toLocalIterator():
        yield row["id"], row["sequence"]


def load_fasta(spark: SparkSession, path: str, min_len: int = C.MIN_SEQUENCE_LENGTH,
               max_len: int | None = None, verbose: bool = True) -> DataFrame:
    """(ordinal, id, sequence) of a FASTA file; records are split by the reader itself."""
    chunks = numbered_records(spark, path, "\n>")
    # only the very first chunk still has its marker; without one it precedes all records
    record = F.when(F.col("line_no") > 0, F.col("value")).when(
        F.startswith("value", F.lit(">")), F.expr("substring(value, 2)"))
    split = chunks.select("line_no", record.alias("record")).filter("record is not null").select(
        "line_no", F.trim(F.regexp_extract("record", "^[^\\r\\n]*", 0)).alias("header"),
        F.regexp_replace("record", "^[^\\r\\n]*", "").alias("raw"))
    rows = split.filter(F.col("header") != "").select(
        F.col("line_no").alias("row_num"), F.split("header", "\\s+")[0].alias("id"), "raw")
    return _finish(clean_records(rows, min_len, max_len), "dup", path, verbose)


def load_sequences(spark: SparkSession, path: str, id_col: str | None = None,
                   seq_col: str | None = None, delimiter: str | None = None,
                   min_len: int = C.MIN_SEQUENCE_LENGTH, max_len: int | None = None,
                   verbose: bool = True) -> DataFrame:
    """FASTA by file suffix, delimited text otherwise."""
    if os.path.splitext(path)[1].lower() in C.FASTA_SUFFIXES:
        return load_fasta(spark, path, min_len, max_len, verbose)
    return load_csv(spark, path, id_col, seq_col, delimiter, min_len, max_len, verbose)
