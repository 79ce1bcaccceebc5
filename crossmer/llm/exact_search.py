"""Exact top-k inner products by columnar branch-and-bound (operator 11).

Vectors are cut into blocks in vertical layout: all values of one dimension lie
together, so a block of dimensions is one contiguous piece of every vector. For a
block of queries and a block of candidates

1. dimensions are taken in the order of the candidates' mass, DIMENSIONS at a time,
   and their part of the inner product is added up;
2. what is missing of a score is at most the product of the remaining masses
   (Cauchy-Schwarz). A candidate stays only if score so far plus that bound reaches
   the query's k-th best known score, which starts from the exact scores of the
   candidates that lead after the first dimensions;
3. while many candidates are left the next dimensions are one matrix product over
   the columns that still have a survivor; when few are left they are compacted into
   a list of (query, candidate) pairs.

A task keeps the k best of every query it has seen, so later blocks are cut sooner.
Bounds are only used to drop what cannot be among the k best: results are exact, in
32-bit or 64-bit floating point while integers are exact in it, in 64-bit integers
beyond, and in Python integers beyond that (saturated to the range of bigint).

All queries meet all candidates, so the work is their product. Query blocks go to
CELLS of candidate blocks; both have a bounded size, and a row of the join is one unit
of work. Nothing is collected but the number of blocks and queries.

Cases: vectors that are null or hold null or non-finite values take no part; missing
values of a shorter vector count as zero, so an empty vector scores 0; equal vectors
and equal vec_ids are different rows, and only the query's own row is left out; a null
vec_id is no query and comes last in ties; an empty table has no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from crossmer.llm.common import table
from crossmer.operators.storage import materialize

TOP = 5
SCALE = 256
QUERY_MODULUS = 50
DIMENSIONS = 16            # taken together
BLOCK_VALUES = 1 << 18     # of a block: at most 2 MB
BLOCK_ROWS = 4096
QUERY_ROWS = 256           # scored together: at most 256 x 4096 sums at a time
FEW = 0.05                 # share of survivors from which on they are a list of pairs

BLOCKS = "block long, ids array<long>, size int, kind string, values binary"
QUERIES = "q_block long, q_places array<struct<block: long, at: int>>, q_ids array<long>, q_size int, q_kind string, q_values binary"
FOUND = "block long, at int, query_id long, vec_id long, score long"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


# --- vertical layout -----------------------------------------------------------------

def _packed(values: np.ndarray) -> tuple[str, bytes]:
    """Integers held as floats, in the smallest type that has them."""
    most = np.abs(values).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, values.astype(kind).tobytes()


def _unpacked(kind: str, raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable row, length, flat values of all rows) of an Arrow list column."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    usable = column.is_valid().to_numpy(zero_copy_only=False).copy()
    usable[row_of[~np.isfinite(values)]] = False
    return usable, sizes, values


def vertical_blocks(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """block, ids, size, kind, values: the usable vectors of (vec_id, embedding), dimension after dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            usable, sizes, values = _ragged(batch.column(1))
            ends = np.cumsum(sizes)
            ids = batch.column(0)
            order = np.flatnonzero(usable)
            order = order[np.argsort(sizes[order], kind="stable")]
            start = 0
            while start < len(order):
                stop = min(len(order), start + BLOCK_ROWS)
                while stop > start + 1 and sizes[order[stop - 1]] * (stop - start) > BLOCK_VALUES:
                    stop = start + (stop - start) // 2
                rows = order[start:stop]
                width = int(sizes[rows].max(initial=0))
                held = np.zeros((width, len(rows)))
                for at, row in enumerate(rows):
                    held[:sizes[row], at] = values[ends[row] - sizes[row]:ends[row]]
                with np.errstate(over="ignore"):
                    held = np.nan_to_num(np.floor(scale * held), posinf=np.finfo(float).max, neginf=-np.finfo(float).max)
                kind, raw = _packed(held)
                yield pa.RecordBatch.from_pydict({
                    "block": [number], "ids": [ids.take(pa.array(rows)).to_pylist()], "size": [len(rows)],
                    "kind": [kind], "values": [raw]}, schema=_BLOCK_SCHEMA)
                number, start = number + 1, stop

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, BLOCKS)


_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("size", pa.int32()),
                           ("kind", pa.string()), ("values", pa.binary())])
_QUERY_SCHEMA = pa.schema([
    ("q_block", pa.int64()), ("q_places", pa.list_(pa.struct([("block", pa.int64()), ("at", pa.int32())]))),
    ("q_ids", pa.list_(pa.int64())), ("q_size", pa.int32()), ("q_kind", pa.string()), ("q_values", pa.binary())])


def query_rows(blocks: DataFrame, modulus: int) -> DataFrame:
    """q_id, block, at, kind, vector: the queries, taken out of the blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = [i for i, v in enumerate(row["ids"]) if v is not None and v % modulus == 0]
                wide = np.frombuffer(row["values"], dtype=row["kind"]).reshape(-1, row["size"])
                yield pa.RecordBatch.from_pydict({
                    "q_id": [row["ids"][i] for i in asked], "block": [row["block"]] * len(asked), "at": asked,
                    "kind": [row["kind"]] * len(asked), "vector": [wide[:, i].tobytes() for i in asked]}, schema=schema)

    schema = pa.schema([("q_id", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("kind", pa.string()), ("vector", pa.binary())])
    return blocks.mapInArrow(run, "q_id long, block long, at int, kind string, vector binary")


def query_blocks(rows: DataFrame, tasks: int) -> DataFrame:
    """The queries dealt out to `tasks` partitions and packed there, vector after vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, most = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            wide = np.zeros((len(held), most))
            for at, (_, _, vector) in enumerate(held):
                wide[at, :len(vector)] = vector
            kind, raw = _packed(wide)
            return pa.RecordBatch.from_pydict({
                "q_block": [number], "q_places": [[{"block": p[0], "at": p[1]} for _, p, _ in held]],
                "q_ids": [[i for i, _, _ in held]], "q_size": [len(held)], "q_kind": [kind], "q_values": [raw]},
                schema=_QUERY_SCHEMA)

        for batch in batches:
            for q_id, block, at, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vector = np.frombuffer(raw, dtype=kind).astype(np.float64)
                if held and (len(held) == BLOCK_ROWS or max(most, len(vector)) * (len(held) + 1) > BLOCK_VALUES):
                    yield packed()
                    number, held, most = number + 1, [], 0
                held.append((q_id, (block, at), vector))
                most = max(most, len(vector))
        if held:
            yield packed()

    return rows.repartition(tasks, "block", "at").mapInArrow(run, QUERIES)


# --- branch and bound -----------------------------------------------------------------

def _exact_type(queries: np.ndarray, columns: np.ndarray) -> type:
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(1, len(columns))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def survivors(queries: np.ndarray, columns: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    """(query, candidate, score) of every pair that can be among the k best.

    `queries` are rows, `columns` the candidates in vertical layout, both of whole numbers in
    float64; `own` is the place of a query's own row (-1: not here), `floor` its k-th best score so far.
    """
    width = min(queries.shape[1], len(columns))       # what either side lacks counts as zero
    queries, columns = queries[:, :width], columns[:width]
    kind = _exact_type(queries, columns)
    size = columns.shape[1]
    mine = np.flatnonzero(own >= 0)
    if kind is object or not width or size <= k + 1:
        wide = (lambda a: np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)) if kind is object else (
            lambda a: a.astype(kind))
        scores = wide(queries) @ wide(columns) if width else np.zeros((len(queries), size))
        kept = np.ones(scores.shape, dtype=bool)
        kept[mine, own[mine]] = False
        q, c = np.nonzero(kept)
        return q, c, np.array([max(_LEAST, min(_MOST, int(s))) for s in scores[q, c]], dtype=np.int64)

    by_mass = np.argsort(-(columns * columns).sum(axis=1), kind="stable")
    queries, columns = queries[:, by_mass], columns[by_mass]
    steps = range(0, width, DIMENSIONS)
    mass = lambda a: np.sqrt((a * a).sum(axis=-1))
    rest_q = [mass(queries[:, at + DIMENSIONS:]) * (1 + 1e-9) for at in steps]
    rest_c = [mass(columns[at + DIMENSIONS:].T) * (1 + 1e-9) for at in steps]
    left, right = queries.astype(kind), columns.astype(kind)

    sums = left[:, :DIMENSIONS] @ right[:DIMENSIONS]
    first = sums.astype(np.float64)
    first[mine, own[mine]] = -np.inf
    leaders = np.argpartition(-first, k - 1, axis=1)[:, :k]
    known = np.einsum("qd,dqk->qk", left, right[:, leaders]).astype(np.float64)
    floor = np.maximum(floor, known.min(axis=1))

    alive = first + rest_q[0][:, None] * rest_c[0][None, :] >= floor[:, None]
    at, used = DIMENSIONS, np.arange(size)
    while at < width and alive.mean() > FEW:
        kept = alive.any(axis=0)
        if not kept.all():
            sums, alive, used = sums[:, kept], alive[:, kept], used[kept]
        sums = sums + left[:, at:at + DIMENSIONS] @ right[at:at + DIMENSIONS][:, used]
        step = at // DIMENSIONS
        alive &= sums + rest_q[step][:, None] * rest_c[step][used][None, :] >= floor[:, None]
        at += DIMENSIONS
    q, c = np.nonzero(alive)
    scores, c = sums[q, c], used[c]
    while at < width and len(q):
        scores = scores + np.einsum("pd,dp->p", left[q, at:at + DIMENSIONS], right[at:at + DIMENSIONS][:, c])
        step = at // DIMENSIONS
        able = scores + rest_q[step][q] * rest_c[step][c] >= floor[q]
        q, c, scores = q[able], c[able], scores[able]
        at += DIMENSIONS
    return q, c, scores.astype(np.int64)


class Best:
    """The k best of every query of one block, by score, then by vec_id (null last)."""

    def __init__(self, size: int, k: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.id, self.unknown, self.score = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
        self.floor = np.full(size, -np.inf)

    def add(self, query, ids, unknown, score) -> None:
        query, ids, unknown, score = (np.concatenate(p) for p in (
            (self.query, query), (self.id, ids), (self.unknown, unknown), (self.score, score)))
        order = np.lexsort((ids, unknown, ~score, query))      # ~score falls as score grows, without overflow
        sorted_ = query[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        order = order[place < self.k]
        self.query, self.id, self.unknown, self.score = query[order], ids[order], unknown[order], score[order]
        full = place[place < self.k] == self.k - 1
        self.floor[self.query[full]] = self.score[full].astype(np.float64) * (1 - 1e-12 * np.sign(self.score[full]))


def top_k(vectors: DataFrame, k: int = TOP, modulus: int = QUERY_MODULUS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row of (vec_id, embedding) whose id is divisible."""
    blocks = materialize(vertical_blocks(vectors, scale))
    asked = materialize(query_rows(blocks, modulus))
    sizes = asked.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vector")), F.lit(0))).first()
    n_blocks = blocks.count()
    tasks = max(1, -(-sizes[0] // BLOCK_ROWS), sizes[0] * sizes[1] // 2 // BLOCK_VALUES)
    queries = materialize(query_blocks(asked, tasks))

    cores = vectors.sparkSession.sparkContext.defaultParallelism
    cells = max(1, min(n_blocks, max(4 * cores, n_blocks // 8)))
    candidates = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")).repartition(cells, "cell")
    everywhere = queries.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).repartition(cells, "cell")
    units = candidates.join(everywhere, "cell").drop("cell")
    found = units.mapInArrow(_scored(k), FOUND)
    order = W.partitionBy("block", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _scored(k: int):
    """Units of work (one block of candidates, one of queries) -> the k best rows that a task saw for a query."""
    names = ("block", "ids", "size", "kind", "values", *[f.split(" ")[0] for f in QUERIES.split(", ") if f.startswith("q_")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for places, q_ids, best in state.values():
                at = best.query.tolist()
                yield pa.RecordBatch.from_pydict({
                    "block": [places[i]["block"] for i in at], "at": [places[i]["at"] for i in at],
                    "query_id": [q_ids[i] for i in at],
                    "vec_id": pa.array(best.id, mask=best.unknown), "score": best.score}, schema=schema)
            state.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(batch.schema.get_field_index(n))[i].as_py() for n in names}
                if row["q_block"] not in state:
                    if sum(len(s[0]) for s in state.values()) > 16 * BLOCK_ROWS:
                        yield from flush()
                    state[row["q_block"]] = (row["q_places"], row["q_ids"], Best(row["q_size"], k))
                _compare(row, state[row["q_block"]][2], k)
        yield from flush()

    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    return run


def _compare(row: dict, best: Best, k: int) -> None:
    queries = _unpacked(row["q_kind"], row["q_values"], row["q_size"])
    columns = np.frombuffer(row["values"], dtype=row["kind"]).astype(np.float64).reshape(-1, row["size"])
    unknown = np.array([v is None for v in row["ids"]])
    ids = np.array([0 if v is None else v for v in row["ids"]], dtype=np.int64)
    own = np.array([p["at"] if p["block"] == row["block"] else -1 for p in row["q_places"]], dtype=np.int64)
    for start in range(0, row["q_size"], QUERY_ROWS):
        part = slice(start, start + QUERY_ROWS)
        q, c, score = survivors(queries[part], columns, own[part], best.floor[part], k)
        best.add(q + start, ids[c], unknown[c], score)


def op11_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


OP11_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.r <> c.r
  WHERE q.vec_id % 50 = 0
),
ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
