"""Best-fit packing of token pieces into sequences (operator 5).

Every document is encoded and, only if longer than a sequence, cut into pieces of
the sequence length. Packing needs nothing but the histogram of piece lengths,
which has at most `capacity` rows whatever the corpus:

1. The configuration linear program (fewest sequences, each filled by one
   configuration of lengths, so that every length is covered) is solved by
   multiplicative weights. A weight falls exponentially with the share of its
   length that is covered already; an unbounded knapsack over the capacity prices
   the configurations, best completion for every length at once.
2. The fractional solution is rounded down and, on what is then left, solved again and
   rounded up as far as pieces last, largest share first, until at most one sequence in
   REST_SHARE (and at most REST_SEQUENCES) is left. So the program places most sequences
   of a small corpus as well as of a large one.
3. The rest is counted in units of u pieces of a length, so that some REST_SEQUENCES
   sequences of units are filled with exact subset sums, largest length first; each
   full one stands for u sequences. The unit shrinks with the rest until it is one piece.
4. The configurations become runs: the pieces of length l with ranks r to r + k
   go to the sequences s to s + k at one offset. A piece finds its place from its
   length and its rank among the pieces of that length.

Ranks are counted within slices of a length, the pieces that one task has written, so a
length shared by a third of all pieces (or by copies of one document) is numbered by many tasks. The runs are broadcast: their number is
bounded by the capacity, ROUNDS, BATCH and REST_SEQUENCES for each of the few
units (their number grows with the logarithm of the corpus); `runs_of` checks it.

Cases: null and empty texts are one piece with the end id; repeated rows are
packed each; null doc_ids stay null; an empty table has no pieces; extra columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from crossmer.llm.common import arrow_map, table
from crossmer.llm.tokens import END_ID, default_tokenizer, encoder
from crossmer.operators.storage import materialize

CAPACITY = 4096
ROUNDS = 8                # multiplicative-weights rounds
ROUNDS_AGAIN = 2          # of each further solution, on what the rounding has left
SLOW = 0.97               # a solution that leaves more than this share is the last one
BATCH = 2048              # configurations taken from each round, at most
STEP = 0.5                # share of the tightest length's open need that a configuration takes
COVERED = 0.95            # a length covered so far is left to the rounding
SAND = 8                  # short pieces kept for each of the last sequences
LONG_FIRST = 1.1          # above 1: of equal fills the one with longer pieces, short ones fill gaps later
STEEPNESS = 3.0           # how fast a weight falls with coverage
REST_SEQUENCES = 3000     # sequences filled one by one for each unit of the rest, at most
REST_SHARE = 12           # one sequence of so many is left to the rest, at most
MAX_RUNS = 2_000_000      # 64 MB as broadcast; far above what the bounds above allow

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None,
                 end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    path, end = tokenizer or default_tokenizer(), struct.pack("<I", end_id)

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1).to_pylist()), strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                for name, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(value)
        return out

    columns = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return arrow_map(columns, cut, PIECES)


# --- the linear program -------------------------------------------------------------

def completions(kinds: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value within every room, and the kind to take first there (-1: none)."""
    best = np.zeros(capacity + 1)
    first = np.full(capacity + 1, -1, dtype=np.int64)
    ends = np.searchsorted(kinds, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], first[room] = best[room - 1], -2      # -2: leave one token free
        if ends[room]:
            values = best[room - kinds[:ends[room]]] + prices[:ends[room]]
            k = int(values.argmax())
            if values[k] > best[room]:
                best[room], first[room] = values[k], k
    return best, first


def completion(first: np.ndarray, kinds: np.ndarray, room: int) -> list[int]:
    taken = []
    while room > 0 and first[room] != -1:
        if first[room] == -2:
            room -= 1
            continue
        taken.append(int(first[room]))
        room -= int(kinds[first[room]])
    return taken


def configurations(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, batch: int = BATCH,
                   seed: int = 0) -> dict[tuple, float]:
    """Fractional solution: configuration (indices of lengths, with repetition) -> number of sequences."""
    kinds = np.flatnonzero(counts)
    need = counts[kinds].astype(float)
    covered = np.zeros(len(kinds))
    solution: dict[tuple, float] = {}
    noise = np.random.default_rng(seed)      # another order among nearly equal completions in every round
    for _ in range(rounds):
        share = covered / need
        prices = (kinds / capacity) ** LONG_FIRST * np.exp(-STEEPNESS * (share - share.min())) * noise.uniform(0.99, 1.01, len(kinds))
        _, first = completions(kinds, prices, capacity)
        for k in np.flatnonzero(share < COVERED)[::-1][:batch]:      # long pieces first, as in best fit
            config = tuple(sorted([int(k), *completion(first, kinds, capacity - int(kinds[k]))]))
            which, times = np.unique(config, return_counts=True)
            step = float(((need[which] - covered[which]) / times).min()) * STEP
            covered[which] += step * times
            solution[config] = solution.get(config, 0.0) + step
    return {tuple(int(kinds[k]) for k in config): x for config, x in solution.items()}


def fill_rest(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Sequences of the rest: the largest length, then the subset of the others that fills best."""
    left = {int(l): int(counts[l]) for l in np.flatnonzero(counts)}
    out = []
    while left:
        largest = max(left)
        _take(left, largest)
        room, config = capacity - largest, [largest]
        while room:
            kinds = sorted((l for l in left if l <= room), reverse=True)
            if not kinds:
                break
            reach, history, mask = 1, [], (1 << (room + 1)) - 1
            for l in kinds:
                for _ in range(min(left[l], room // l)):
                    history.append((l, reach))
                    reach |= (reach << l) & mask
                if reach >> room & 1:
                    break
            target = reach.bit_length() - 1
            for l, before in reversed(history):
                if not before >> target & 1:
                    target -= l
                    _take(left, l)
                    config.append(l)
            break
        out.append(tuple(config))
    return out


def _take(left: dict[int, int], length: int) -> None:
    left[length] -= 1
    if not left[length]:
        del left[length]


def _rest(left: np.ndarray, capacity: int) -> int:
    """Sequences that are left to exact subset sums."""
    needed = -(-int((left * np.arange(len(left))).sum()) // capacity)
    return max(1, min(REST_SEQUENCES, needed // REST_SHARE))


def place_by_program(left: np.ndarray, capacity: int, rest: int) -> list[tuple[tuple[int, ...], int]]:
    """Full configurations of the linear program, taken out of `left` until some `rest` sequences are left."""
    plan: list[tuple[tuple[int, ...], int]] = []
    lengths = np.arange(len(left))
    up = False                # first rounded down, then up to one sequence
    while (tokens := int((left * lengths).sum())) > rest * capacity:
        found = configurations(left, capacity, ROUNDS_AGAIN if up else ROUNDS, seed=len(plan))
        solution = sorted(found.items(), key=lambda c: (-c[1], c[0]))
        if not up:
            up = True
            plan += _take_configurations(left, solution, 0, 0)
            if (left * lengths).sum() < tokens:
                continue
        plan += _take_configurations(left, solution, 1, rest * capacity)
        if (left * lengths).sum() > SLOW * tokens:
            break
    return plan


def _take_configurations(left: np.ndarray, solution: list, least: int, enough: int) -> list[tuple[tuple[int, ...], int]]:
    """Full configurations of a solution, each at least `least` times while pieces last, until `enough` tokens are left."""
    taken, tokens = [], int((left * np.arange(len(left))).sum())
    for config, x in solution:
        which, times = np.unique(config, return_counts=True)
        n = min(max(int(x), least), int((left[which] // times).min()))
        if n > 0 and sum(config) == len(left) - 1:
            left[which] -= n * times
            tokens -= n * (len(left) - 1)
            taken.append((config, n))
            if tokens <= enough:
                break
    return taken


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, number of sequences) that hold exactly counts[l] pieces of every length l."""
    left = counts.astype(np.int64).copy()
    lengths = np.arange(len(left))
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rest = _rest(left, capacity)
    short = np.where(lengths <= capacity // 16, left, 0)
    sand = np.diff(np.minimum(np.cumsum(short), SAND * rest), prepend=0)
    left -= sand                  # fills the gaps of the last sequences
    plan += place_by_program(left, capacity, rest)
    unit = -(-int((left * lengths).sum()) // (REST_SEQUENCES * capacity))
    while unit > 1:
        before = len(plan)
        for config in fill_rest(left // unit, capacity):
            if sum(config) == capacity:       # others wait for a smaller unit
                plan.append((config, unit))
                np.subtract.at(left, list(config), unit)
        needed = -(-int((left * lengths).sum()) // (REST_SEQUENCES * capacity))
        unit = min(needed, unit - 1) if len(plan) > before else unit // 2
    return plan + [(config, 1) for config in fill_rest(left + sand, capacity)]


def runs_of(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """length, rank, sequence, offset: where the pieces of a length with ranks from `rank` on go; sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in plan:
        offset = 0
        for length in config:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    if len(rows) > MAX_RUNS:
        raise ValueError(f"{len(rows)} runs are too many to broadcast")
    rows.sort()
    table_ = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {name: table_[:, k].copy() for k, name in enumerate(("length", "rank", "sequence", "offset"))}


# --- placing the pieces ----------------------------------------------------------------

def ranked(cut: DataFrame) -> DataFrame:
    """The pieces (with `slice`) with `rank`, their number from 0 among the pieces of the same length."""
    before = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        cut.groupBy("length", "slice").count()
        .select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    order = W.partitionBy("length", "slice").orderBy("doc_id", "piece")
    return (
        cut.withColumn("own", F.row_number().over(order) - 1)
        .join(bases, ["length", "slice"])
        .withColumn("rank", F.col("own") + F.col("base"))
        .drop("own", "base")
    )


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (at least doc_id, piece, length, ids_crc32) with sequence_id and offset."""
    names = cut.columns
    cut = materialize(cut.withColumn("slice", F.spark_partition_id()))
    counts = cut.groupBy("length").count()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.collect():        # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    runs = cut.sparkSession.sparkContext.broadcast(runs_of(solve(histogram, capacity)))
    places = "sequence_id long, offset long"

    @F.pandas_udf(places)
    def place(length, rank):
        import pandas as pd

        table_ = runs.value
        key = table_["length"] << 44 | table_["rank"]
        at = np.searchsorted(key, length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table_["sequence"][at] + rank.to_numpy() - table_["rank"][at],
                             "offset": table_["offset"][at]})

    return (
        ranked(cut).withColumn("place", place("length", "rank"))
        .select(*names, "place.sequence_id", "place.offset")
    )


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(documents, capacity), capacity)


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
