"""Equi-joins of lists, in cells of a bounded number of pairs.

A key with l rows on the left and r on the right makes l * r pairs, which one
task would have to compare alone. Keys with more than ``pairs`` of them are cut
into a grid: the left rows of such a key into bands, the right rows likewise,
and a cell of the grid compares about ``pairs`` pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from crossmer.operators.storage import materialize

CELL_PAIRS = 4_000_000
BROADCAST_KEYS = 100_000


def hot_keys(left: DataFrame, right: DataFrame, key: str, pairs: int) -> DataFrame:
    """key, bands, columns: the grid of every key with more than ``pairs`` pairs."""
    side = max(1, math.isqrt(pairs))
    counts = left.groupBy(key).agg(F.count("*").alias("l"))
    counts = (counts.withColumn("r", F.col("l")) if right is left
              else counts.join(right.groupBy(key).agg(F.count("*").alias("r")), key))
    cut = lambda n: F.ceil(F.col(n) / side).cast("int")
    return counts.filter(F.col("l") * F.col("r") > pairs).select(
        key, cut("l").alias("bands"), cut("r").alias("columns"))


def list_join(left: DataFrame, right: DataFrame, key: str, condition: Column,
              pairs: int | None = None) -> DataFrame:
    """Inner join on ``key`` under ``condition``, which names the sides by the aliases l and r.

    Pass the same frame twice for a join of lists with themselves; both sides
    then share one exchange as long as no key is hot.
    """
    pairs = pairs or CELL_PAIRS
    hot = materialize(hot_keys(left, right, key, pairs))
    found = hot.limit(BROADCAST_KEYS + 1).count()
    same = F.col(f"l.{key}") == F.col(f"r.{key}")
    if not found:
        return left.alias("l").join(right.alias("r"), same & condition)
    if found <= BROADCAST_KEYS:
        hot = F.broadcast(hot)      # at most BROADCAST_KEYS rows of a key and two numbers
    place = lambda n: F.pmod(F.xxhash64(F.lit(n), *names), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def placed(frame: DataFrame) -> DataFrame:
        return frame.join(hot, key, "left").withColumns(
            {n: F.coalesce(n, F.lit(1)) for n in ("bands", "columns")})

    names = left.columns
    a = placed(left).withColumn("_band", place("bands")).withColumn("_column", every("columns"))
    names = right.columns
    b = placed(right).withColumn("_column", place("columns")).withColumn("_band", every("bands"))
    return a.drop("bands", "columns").alias("l").join(
        b.drop("bands", "columns").alias("r"),
        same & (F.col("l._band") == F.col("r._band")) & (F.col("l._column") == F.col("r._column")) & condition)
