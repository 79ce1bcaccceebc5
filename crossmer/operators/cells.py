"""Searches of all pairs, cell by cell.

Sequences are dealt into blocks of about equally many residues; each pair of
blocks is one cell, met inside a task, which returns the pairs it finds and
nothing of what it compares. A block is packed into one row, and cells are the
product of these rows: sequences are shuffled and packed once, however many
blocks there are, and every cell reads its two blocks from where they lie. What
a cell finds leaves it in batches of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from crossmer.operators.nodes import NodeSet

LETTERS = 1 << 20       # residues of a block
OUT_ROWS = 1 << 17      # pairs of a batch that leaves a cell
_FEW_CELLS = 4          # cells per core at least, on small inputs
_PARTS = 128            # of a side, at most; a task meets the blocks of two


def meet(nodes: NodeSet, frame: DataFrame, find: Callable, found: T.StructType, carried: tuple[str, ...] = (),
         letters: int = LETTERS, limit: int | None = None, given: tuple[str, ...] = (),
         targets: tuple[NodeSet, DataFrame] | None = None) -> DataFrame:
    """Every pair that ``find`` reports, once: a_node < b_node, the carried columns of both, ``found``.

    With ``targets``, the nodes and frame of another set, a comes from ``nodes``
    and b from the targets: all pairs of the two sets, in whatever order.

    ``frame`` has columns node, text, the carried and the given ones. ``find(left
    texts, right texts, within)`` yields arrays (left row, right row, *columns of
    found); within a block only pairs left < right. It is also passed each given
    column of numbers, left and right. Columns of ``found`` that
    start with a_ or b_ belong to an end and change places with it. ``limit``
    sets the sequences of a block instead of ``letters``.
    """
    names = ["node", *carried]
    cells = _cells(nodes, frame, [*names, *given, "text"], letters, limit, targets)
    sides = frame.schema, (targets[1] if targets else frame).schema
    schema = T.StructType([T.StructField(f"{s}_{n}", kinds[n].dataType) for s, kinds in zip("ab", sides) for n in names] + found.fields)
    columns = [f.name for f in found.fields]
    between = targets is not None

    def ends_of(l_rows: pa.Table, r_rows: pa.Table, kinds: pa.Schema) -> Callable:
        if between:
            def rows(x, y, *rest):
                out = [rows.column(n).take(pa.array(side)) for rows, side in ((l_rows, x), (r_rows, y)) for n in names]
                return pa.table([*out, *map(pa.array, rest)], names=schema.names).cast(kinds)
            return rows
        ends = pa.concat_tables([rows.select(names) for rows in (l_rows, r_rows)]).combine_chunks()
        node = ends.column("node").to_numpy()
        other = {n: ("b" if n[0] == "a" else "a") + n[1:] for n in columns if n[:2] in ("a_", "b_")}

        def rows(x, y, *rest):
            y = y + l_rows.num_rows
            different = node[x] != node[y]          # not two segments of one sequence
            x, y, *rest = (column[different] for column in (x, y, *rest))
            swapped = node[x] > node[y]
            a, b = np.where(swapped, y, x), np.where(swapped, x, y)
            values = dict(zip(columns, rest))
            out = [ends.column(n).take(pa.array(side)) for side in (a, b) for n in names]
            out += [pa.array(np.where(swapped, values[other[n]], values[n]) if n in other else values[n]) for n in columns]
            return pa.table(out, names=schema.names).cast(kinds)
        return rows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow(schema)
        for i, j, l_rows, r_rows in _met(batches):
            texts = [rows.column("text").to_pylist() for rows in (l_rows, r_rows)]
            numbers = [rows.column(c).to_numpy() for c in given for rows in (l_rows, r_rows)]
            rows = ends_of(l_rows, r_rows, kinds)
            for piece in pieces(find(*texts, not between and i == j, *numbers), OUT_ROWS):
                yield from rows(*piece).combine_chunks().to_batches()

    return cells.mapInArrow(search, schema)


def tally(nodes: NodeSet, frame: DataFrame, find: Callable, letters: int = LETTERS, limit: int | None = None,
          given: tuple[str, ...] = ()) -> DataFrame:
    """node, others: sums over all pairs of blocks, of the sequences that have any.

    ``find`` is called as by ``meet`` and yields two arrays of sums, of the left and of the right rows.
    """
    schema = T.StructType([T.StructField("node", frame.schema["node"].dataType), T.StructField("others", T.LongType())])

    def sums(left, right, within, l_node, r_node, *numbers):
        totals = [np.zeros(len(side), dtype=np.int64) for side in (left, right)]
        for part in find(left, right, within, *numbers):
            for total, own in zip(totals, part):
                total += own
        node, others = np.concatenate((l_node, r_node)), np.concatenate(totals)
        yield node[others > 0], others[others > 0]

    return fold(nodes, frame, sums, schema, letters, limit, ("node", *given)).groupBy("node").agg(
        F.sum("others").alias("others"))


def fold(nodes: NodeSet, frame: DataFrame, find: Callable, found: T.StructType, letters: int = LETTERS,
         limit: int | None = None, given: tuple[str, ...] = ()) -> DataFrame:
    """What ``find``, called as by ``meet``, yields in all cells: arrays of the columns of ``found``.

    Given columns of lists are passed as Arrow arrays.
    """
    cells = _cells(nodes, frame, list(dict.fromkeys(["node", *given, "text"])), letters, limit)
    plain = lambda rows, c: (
        rows.column(c).combine_chunks() if pa.types.is_list(rows.schema.field(c).type) else rows.column(c).to_numpy())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow(found)
        for i, j, *sides in _met(batches):
            columns = [plain(rows, c) for c in given for rows in sides]
            for part in find(*[rows.column("text").to_pylist() for rows in sides], i == j, *columns):
                for first in range(0, len(part[0]), OUT_ROWS):
                    rows = [pa.array(column[first: first + OUT_ROWS]) for column in part]
                    yield from pa.table(rows, names=kinds.names).cast(kinds).to_batches()

    return cells.mapInArrow(search, found)


def _cells(nodes: NodeSet, frame: DataFrame, sent: list[str], letters: int, limit: int | None,
           targets: tuple[NodeSet, DataFrame] | None = None) -> DataFrame:
    """All cells: i, left, j, right; the numbers of two blocks and their rows of the sent columns, packed."""
    few = math.ceil(math.sqrt(2 * _FEW_CELLS * frame.sparkSession.sparkContext.defaultParallelism))

    def packed(own: NodeSet, rows: DataFrame) -> DataFrame:
        # blocks of distinct sequences: their residues are at most those of all copies
        filled = math.ceil(own.residues / letters)
        count = math.ceil(max(own.count, 1) / limit) if limit else max(min(few, max(1, own.count // 64)), filled)
        placed = rows.filter("node IS NOT NULL").select(
            *sent, F.pmod(F.xxhash64("node"), F.lit(count)).cast("int").alias("_home"))

        def pack(key: tuple, block: pa.Table) -> pa.Table:
            block = block.select(sent).sort_by("node").combine_chunks()
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, block.schema) as stream:
                stream.write_table(block)
            return pa.table({"home": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})

        parts = min(count, max(few, filled), _PARTS)
        return placed.groupBy("_home").applyInArrow(pack, "home int, rows binary").repartitionById(parts, "home")

    lefts = packed(nodes, frame)
    left = lefts.select(F.col("home").alias("i"), F.col("rows").alias("left"))
    right = (packed(*targets) if targets else lefts).select(F.col("home").alias("j"), F.col("rows").alias("right"))
    left = left.hint("shuffle_replicate_nl")        # the product reads blocks where they lie, and is not broadcast
    return left.crossJoin(right) if targets else left.join(right, F.col("i") <= F.col("j"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table, pa.Table]]:
    """Numbers and rows of the two blocks of every cell."""
    rows = lambda packed: pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()
    held, left = None, None
    for batch in batches:
        for i, own, j, other in zip(*[batch.column(c) for c in ("i", "left", "j", "right")]):
            if held != i.as_py():
                held, left = i.as_py(), rows(own)
            yield held, j.as_py(), left, rows(other)


def pieces(parts: Iterator[tuple], rows: int) -> Iterator[tuple]:
    """Arrays of pairs in pieces of at most so many rows; small ones are joined."""
    held, size = [], 0
    for columns in parts:
        for first in range(0, len(columns[0]), rows):
            held.append([column[first: first + rows] for column in columns])
            size += len(held[-1][0])
            if size >= rows:
                joined = [np.concatenate(column) for column in zip(*held)]
                yield tuple(column[:rows] for column in joined)
                held, size = [[column[rows:] for column in joined]], size - rows
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])
