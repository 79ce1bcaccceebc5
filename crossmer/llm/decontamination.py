"""Benchmark passages in documents, with edits (operator 9).

Items and documents are compared as lower-case words joined by single spaces. An
item of m characters may be found with k = m // CHARS_PER_ERROR edits. It is split
into k + 1 pieces: k edits cannot touch them all, so every passage contains one
piece unchanged (pigeonhole). One automaton finds all pieces of all items in one
pass over a text; around a hit, Myers' bit-parallel algorithm computes the edit
distance of the item to every passage that ends there, and again backwards to find
where it begins. Nothing is missed within the error budget and nothing beyond it is
reported.

The items are the query set. They are broadcast in blocks of at most BLOCK_CHARS
characters, counted first; each block is one pass over the documents, which are
never shuffled.

Cases: null and empty items and items without letters or digits are never found;
an item shorter than CHARS_PER_ERROR must appear exactly, as whole words; null and
empty texts contain nothing; repeated documents and items each have their rows;
a passage that fits several items is reported for each; texts of any length are
scanned whole; an empty table on either side gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossmer.llm.common import pieces, table

CHARS_PER_ERROR = 16
BLOCK_CHARS = 16 << 20
WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id long, item_id long, begin long, end long, distance long, budget long"


def normal(text: str) -> str:
    return " ".join(WORD.findall(text)).lower()


class Item:
    """An item with its error budget, pieces and letter masks."""

    def __init__(self, number: int, text: str):
        self.number, self.text = number, text
        self.budget = len(text) // CHARS_PER_ERROR
        parts, n = self.budget + 1, len(text)
        bounds = [n * j // parts for j in range(parts + 1)]
        self.pieces = [(bounds[j], text[bounds[j]:bounds[j + 1]]) for j in range(parts)]
        self.masks, self.reversed_masks = _masks(text), _masks(text[::-1])


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, letter in enumerate(pattern):
        masks[letter] |= 1 << i
    return dict(masks)


def distances(masks: dict[str, int], m: int, text: str, anchored: bool) -> Iterator[int]:
    """After each letter of text: distance of the pattern to the best passage ending there.

    With `anchored` the passage starts at the beginning of text.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for letter in text:
        equal = masks.get(letter, 0)
        vertical = equal | down
        cross = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(cross | up) & full, up & cross
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | (1 if anchored else 0)) & full
        minus = minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
        yield score


class Matcher:
    """All passages of a block of items in a normalized text."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [Item(n, t) for n, t in items]
        self._automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, item in enumerate(self.items):
            for at, piece in item.pieces:
                owners[piece].append((k, at))
        for piece, places in owners.items():
            self._automaton.add_word(piece, (len(piece), places))
        if owners:
            self._automaton.make_automaton()
        self._empty = not owners

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item number, begin, end, distance, budget) in positions of the normalized text."""
        if self._empty or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (length, places) in self._automaton.iter(text):
            for k, at in places:
                item = self.items[k]
                start = last - length + 1 - at
                windows[k].append((max(0, start - item.budget), min(len(text), start + len(item.text) + item.budget)))
        found = []
        for k, spans in windows.items():
            item = self.items[k]
            for begin, end in _joined(spans):
                found += self._verified(item, text, begin, end)
        return found

    def _verified(self, item: Item, text: str, begin: int, end: int) -> Iterator[tuple]:
        m, budget = len(item.text), item.budget
        if not budget:
            at = text.find(item.text, begin, end)
            while at >= 0:
                if f" {text[max(0, at - 1):at + m + 1]} ".find(f" {item.text} ") >= 0:
                    yield item.number, at, at + m, 0, 0
                at = text.find(item.text, at + m, end)
            return
        best: tuple[int, int] | None = None
        for i, d in enumerate(distances(item.masks, m, text[begin:end], False)):
            if best and begin + i + 1 - best[1] > m // 2:      # far enough for another passage
                yield self._placed(item, text, begin, best)
                best = None
            if d <= budget and (best is None or d < best[0]):
                best = (d, begin + i + 1)
        if best:
            yield self._placed(item, text, begin, best)

    @staticmethod
    def _placed(item: Item, text: str, begin: int, best: tuple[int, int]) -> tuple:
        distance, stop = best
        m = len(item.text)
        back = text[max(begin, stop - m - item.budget):stop][::-1]
        for i, d in enumerate(distances(item.reversed_masks, m, back, True)):
            if d == distance:
                return item.number, stop - i - 1, stop, distance, item.budget
        return item.number, stop, stop, distance, item.budget


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normalized text as spans of the words of the text itself."""
    from bisect import bisect_right

    starts, places, at = [], [], 0
    for word in WORD.finditer(text):
        starts.append(at)
        places.append(word.span())
        at += len(word[0].lower()) + 1
    out = []
    for begin, end in spans:
        first, last = bisect_right(starts, begin) - 1, bisect_right(starts, max(begin, end - 1)) - 1
        lead, tail = begin - starts[first], end - starts[last]
        a, b = places[first], places[last]
        out.append((min(a[0] + lead, a[1]), min(b[0] + tail, b[1])))
    return out


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[int, str]]) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items)
    return _matchers[key]


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The normalized items in blocks of about `block_chars` characters."""
    usable = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    total = usable.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = -(-int(total) // block_chars)
    for k in range(count):
        block = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        rows = [(r["item_id"], normal(r["text"])) for r in block.collect()]
        yield [(n, t) for n, t in rows if t]


def contaminated(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, begin, end, distance, budget of every passage (positions in the text)."""
    import uuid

    spark: SparkSession = documents.sparkSession
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])
    result = spark.createDataFrame([], FOUND)
    for items_of_block in item_blocks(items, block_chars):
        shared, key = spark.sparkContext.broadcast(items_of_block), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            matcher = _matcher(key, shared.value)
            for batch in pieces(batches, "text"):
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = matcher.find(normal(text)) if text else ()
                    if found:
                        spans = original_spans(text, [(f[1], f[2]) for f in found])
                        rows += [(doc_id, f[0], *span, f[3], f[4]) for f, span in zip(found, spans, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], schema=schema)

        result = result.unionByName(columns.mapInArrow(run, FOUND))
    return result


def _clean(spark: SparkSession, items_of_block: list[tuple[int, str]]) -> Column:
    """Whether `text` contains no passage of these items."""
    import uuid

    shared, key = spark.sparkContext.broadcast(items_of_block), uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(key, shared.value)
        for texts in batches:
            yield pd.Series([not (isinstance(t, str) and t and matcher.find(normal(t))) for t in texts], dtype=bool)

    return clean("text")


def without_passages(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that contain no item's passage, with all their columns.

    Every row is decided by its own text, whatever its doc_id; rows are not shuffled.
    """
    for items_of_block in item_blocks(items, block_chars):
        documents = documents.filter(_clean(documents.sparkSession, items_of_block))
    return documents


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
