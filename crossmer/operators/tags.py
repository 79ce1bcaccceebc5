"""N-terminal tag removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crossmer import constants as C
from crossmer.operators.scoring import sw_align


def strip_tag_exact(sequence: Column, tag: str) -> Column:
    """struct(stripped, tag_found): everything up to the first occurrence is cut."""
    at = F.instr(F.upper(sequence), tag.upper())
    return F.struct(
        F.when(at > 0, F.substring(sequence, at + len(tag), F.length(sequence)))
        .otherwise(sequence).alias("stripped"),
        (at > 0).alias("tag_found"),
    )


def strip_tag_sw(sequence: Column, tag: str) -> Column:
    """struct(stripped, tag_found, score): align the tag to the N-terminal window."""
    found = sw_align(F.lit(tag.upper()), F.substring(sequence, 1, C.TAG_WINDOW))
    good = found["raw_score"] >= C.TAG_MIN_SCORE
    return F.struct(
        F.when(good, F.substring(sequence, found["target_end"] + 1, F.length(sequence)))
        .otherwise(sequence).alias("stripped"),
        good.alias("tag_found"), found["raw_score"].alias("score"),
    )


def strip_tags(frame: DataFrame, column: str, tag: str, method: str = "sw") -> DataFrame:
    """Add original, stripped, tag_found, method_used and score to a frame.

    Exact search first; with ``method='sw'`` the alignment runs only on rows
    without an exact match (other rows send it an empty string).
    """
    base = frame.withColumn("original", F.upper(F.trim(F.col(column)))).withColumn(
        "_exact", strip_tag_exact(F.col("original"), tag))
    exact = F.col("_exact.tag_found")
    if method != "sw":
        return base.select(
            *frame.columns, "original", F.col("_exact.stripped").alias("stripped"),
            exact.alias("tag_found"),
            F.when(exact, F.lit("exact")).otherwise(F.lit("none")).alias("method_used"),
            F.lit(None).cast("int").alias("score"),
        )
    base = base.withColumn("_left", F.when(exact, F.lit("")).otherwise(F.col("original")))
    base = base.withColumn("_sw", strip_tag_sw(F.col("_left"), tag))
    found = exact | F.col("_sw.tag_found")
    return base.select(
        *frame.columns, "original",
        F.when(exact, F.col("_exact.stripped")).otherwise(F.col("_sw.stripped")).alias("stripped"),
        found.alias("tag_found"),
        F.when(exact, F.lit("exact")).when(found, F.lit("sw")).otherwise(F.lit("none"))
        .alias("method_used"),
        F.when(~exact, F.col("_sw.score")).alias("score"),
    )
