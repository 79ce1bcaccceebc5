"""Pair scoring: the alignment recurrence as Arrow-batched UDFs.

The UDFs are declared nondeterministic only so that the optimizer never
evaluates one twice (once for a filter, once for the output).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from crossmer import constants as C
from crossmer.functions import statistics as S
from crossmer.kernels import align, kmers
from crossmer.kernels.align import align_pairs

_BATCH_ROWS = 16_384
_BATCH_LETTERS = 1 << 22

_CELL_PAIRS = 1 << 20       # pairs of a cell that are scored at a time
_REALIGNED = 4_096

_ALIGNED = T.StructType([
    T.StructField(n, T.IntegerType()) for n in ("raw_score", "target_end", "query_end")])
_BATCH = T.StructType([
    T.StructField(n, T.IntegerType())
    for n in ("raw_score", "run", "run_query_end", "run_target_end")])


def gathered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[tuple[list, list]]:
    """Join Arrow batches into larger ones, bounded in rows and letters.

    The kernels tile pairs by size; more pairs at a time make fuller tiles.
    """
    left, right, letters = [], [], 0
    for a, b in batches:
        left += a.tolist()
        right += b.tolist()
        letters += int(a.str.len().sum() + b.str.len().sum())
        if len(left) >= _BATCH_ROWS or letters >= _BATCH_LETTERS:
            yield left, right
            left, right, letters = [], [], 0
    if left:
        yield left, right


def sw_align(query: Column, target: Column, gap_open: int = C.GAP_OPEN,
             gap_extend: int = C.GAP_EXTEND, unknown: int = C.UNKNOWN_SCORE) -> Column:
    """struct(raw_score, target_end, query_end) of the best local alignment.

    ``target_end`` is the 1-based end in the target of the first best cell in
    query order, ``query_end`` the same with the roles exchanged; 0 when
    nothing aligns.
    """
    @F.pandas_udf(_ALIGNED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for q, t in gathered(batches):
            found = align_pairs(q, t, gap_open, gap_extend, unknown)
            yield pd.DataFrame({"raw_score": found.score, "target_end": found.target_end,
                                "query_end": found.query_end})

    return run.asNondeterministic()(F.upper(query), F.upper(target))


def sw_score_only(query: Column, target: Column, gap_open: int = C.GAP_OPEN,
                  gap_extend: int = C.GAP_EXTEND, unknown: int = C.UNKNOWN_SCORE) -> Column:
    """Best local score; the same in both directions."""
    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in gathered(batches):
            yield pd.Series(align_pairs(q, t, gap_open, gap_extend, unknown, with_end=False).score)

    return run.asNondeterministic()(query, target)


def sw_batch(query: Column, target: Column, gap_open: int = C.GAP_OPEN,
             gap_extend: int = C.GAP_EXTEND, min_run: int = C.MIN_RUN) -> Column:
    """struct(raw_score, run, run_query_end, run_target_end) as the screen needs it.

    A run shorter than ``min_run`` is reported as 0 with positions -1.
    """
    @F.pandas_udf(_BATCH)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for q, t in gathered(batches):
            found = align_pairs(q, t, gap_open, gap_extend, C.UNKNOWN_SCORE_BATCH,
                                with_end=False, run_from=min_run)
            short = found.run < min_run
            yield pd.DataFrame({
                "raw_score": found.score,
                "run": found.run * ~short,
                "run_query_end": found.run_query_end * ~short - short,
                "run_target_end": found.run_target_end * ~short - short,
            })

    return run.asNondeterministic()(query, target)


def batch_hits(pairs, left: list[str], right: list[str], floors, within: bool, min_run: int = C.MIN_RUN):
    """(left row, right row, passing columns, score, run, its left and right end, its right and left end) of hits.

    ``pairs`` yields arrays of rows and two passing columns. The second two ends
    are those with the right side as query. A pair is a hit if it reaches the
    floor of either end or has an identical run of ``min_run``. Runs are looked
    for only in pairs that share a k-mer that long.
    """
    n = max(len(right), 1)
    shared = [x * n + y for x, y, _ in kmers.shared_kmers(
        [t.upper() for t in left], [t.upper() for t in right], min_run, within)]
    shared = np.sort(np.concatenate(shared)) if shared else np.zeros(0, dtype=np.int64)
    sides = align.encode(left), align.encode(right)
    for x, y, *passed in _chunks(pairs):
        score = align.pair_scores(*sides, x, y, unknown=C.UNKNOWN_SCORE_BATCH)
        key = x * n + y
        at = np.minimum(np.searchsorted(shared, key), max(len(shared) - 1, 0))
        alike = shared[at] == key if len(shared) else np.zeros(len(key), dtype=bool)
        kept = alike | (score >= np.minimum(floors[0][x], floors[1][y]))
        x, y, score, alike = x[kept], y[kept], score[kept], np.flatnonzero(alike[kept])
        passed = [column[kept] for column in passed]
        # run, query end and target end, with the left and with the right end as query
        found = [np.full(len(x), fill, dtype=np.int32) for fill in (0, -1, -1, -1, -1)]
        for first in range(0, len(alike), _REALIGNED):
            rows = alike[first: first + _REALIGNED]
            texts = [left[i] for i in x[rows]], [right[i] for i in y[rows]]
            for way, (q, t) in enumerate((texts, texts[::-1])):
                runs = align_pairs(q, t, unknown=C.UNKNOWN_SCORE_BATCH, with_end=False, run_from=min_run)
                long = runs.run >= min_run
                found[0][rows] = np.where(long, runs.run, 0)
                found[1 + 2 * way][rows] = np.where(long, runs.run_query_end, -1)
                found[2 + 2 * way][rows] = np.where(long, runs.run_target_end, -1)
        hit = (found[0] > 0) | (score >= np.minimum(floors[0][x], floors[1][y]))
        yield tuple(column[hit] for column in (x, y, *passed, score, *found))


def end_hits(pairs, left: list[str], right: list[str], floors, most):
    """(left row, right row, score, left end, right end) of the pairs that reach the floor of either end.

    ``most`` holds the scores of all texts against themselves: no pair scores
    more, and one that cannot reach a floor is not aligned.
    """
    sides = align.encode(left), align.encode(right)
    for x, y in _chunks(pairs):
        floor = np.minimum(floors[0][x], floors[1][y])
        able = np.minimum(most[0][x], most[1][y]) >= floor
        x, y, floor = x[able], y[able], floor[able]
        found = align.pair_ends(*sides, x, y, floor, C.UNKNOWN_SCORE)
        hit = found[0] >= floor
        yield tuple(column[hit] for column in (x, y, *found))


def _chunks(pairs):
    """Arrays of pairs in pieces of bounded size; small ones are joined, since full tiles are cheaper."""
    held, size = [], 0
    for columns in pairs:
        for first in range(0, len(columns[0]), _CELL_PAIRS):
            held.append([column[first: first + _CELL_PAIRS] for column in columns])
            size += len(held[-1][0])
            if size >= _CELL_PAIRS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def align_pair(pairs: DataFrame, query: str, target: str, db_size: int = C.DEFAULT_DB_SIZE,
               matrix: str = "blosum62") -> DataFrame:
    """Add raw_score, bit_score, evalue, lengths and aligned_region_len to a pair frame."""
    lam, k, h = S.karlin_altschul(C.GAP_OPEN, C.GAP_EXTEND, matrix)
    scored = pairs.withColumn("_s", sw_align(F.col(query), F.col(target)))
    raw = F.col("_s.raw_score")
    return scored.select(
        *pairs.columns, raw.alias("raw_score"),
        S.bit_score(raw, lam, k).alias("bit_score"),
        S.evalue(raw, F.length(query), db_size, lam, k, h).alias("evalue"),
        F.length(query).alias("query_length"), F.length(target).alias("target_length"),
        F.col("_s.target_end").alias("aligned_region_len"),
    )


def batch_align(query: str, candidates: DataFrame, query_id: str = "query",
                max_evalue: float = C.MAX_EVALUE, min_aligned_len: int = C.MIN_ALIGNED,
                db_size: int = C.DEFAULT_DB_SIZE, matrix: str = "blosum62") -> DataFrame:
    """One literal query against a frame (id, ordinal, sequence), best E-value first."""
    pairs = candidates.select(
        F.lit(query_id).alias("query_id"), F.col("id").alias("target_id"), "ordinal",
        F.lit(query).alias("query_seq"), F.col("sequence").alias("target_seq"),
    )
    return (
        align_pair(pairs, "query_seq", "target_seq", db_size, matrix)
        .filter((F.col("evalue") <= max_evalue) & (F.col("aligned_region_len") >= min_aligned_len))
        .orderBy("evalue", "ordinal").drop("ordinal")
    )
