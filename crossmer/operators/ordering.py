"""Positions in a total order, computed without sorting into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crossmer.operators.storage import materialize


def _ranges(frame: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``_range``, numbers of consecutive ranges of the order.

    Written once, so that both uses see the same ranges.
    """
    return materialize(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _before(cut: DataFrame, value: Column) -> DataFrame:
    """Sum of ``value`` in all ranges before; one row per range takes part."""
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return cut.groupBy("_range").agg(value.alias("_t")).select(
        "_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))


def running_total(frame: DataFrame, ordinal: str, value: Column, name: str) -> DataFrame:
    """Add the inclusive running sum of ``value`` in ``ordinal`` order."""
    cut = _ranges(frame.withColumn("_v", value), F.col(ordinal))
    inside = W.partitionBy("_range").orderBy(ordinal)
    return (
        cut.join(_before(cut, F.sum("_v")), "_range")
        .withColumn(name, F.sum("_v").over(inside) + F.col("_o"))
        .drop("_range", "_v", "_o")
    )


def screen_rank(frame: DataFrame) -> DataFrame:
    """0-based position of (length, ordinal) rows in screen order: longer first."""
    order = F.desc("length"), F.asc("ordinal")
    cut = _ranges(frame, *order)
    inside = W.partitionBy("_range").orderBy(*order)
    return (
        cut.join(_before(cut, F.count("*")), "_range")
        .withColumn("rank", F.row_number().over(inside) - 1 + F.col("_o"))
        .drop("_range", "_o")
    )
