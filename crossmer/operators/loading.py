"""Record rules shared by all loaders: cleaning, validity, unique ids, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crossmer import constants as C
from crossmer.functions.sequence import clean_sequence, is_valid_sequence
from crossmer.operators.ordering import running_total


def clean_records(records: DataFrame, min_len: int = C.MIN_SEQUENCE_LENGTH,
                  max_len: int | None = None) -> DataFrame:
    """(row_num, id, raw) -> the same with ``sequence`` and ``valid``.

    A missing id becomes ``antigen_<row_num>``. Too long sequences are invalid,
    not truncated.
    """
    sequence = clean_sequence(F.coalesce("raw", F.lit("")))
    named = F.trim(F.coalesce("id", F.lit("")))
    valid = is_valid_sequence(F.col("sequence"), min_len)
    if max_len:
        valid = valid & (F.length("sequence") <= max_len)
    return (
        records.withColumn("id", F.when(named == "", F.concat(
            F.lit("antigen_"), F.col("row_num"))).otherwise(named))
        .withColumn("sequence", sequence).withColumn("valid", valid).drop("raw")
    )


def unique_ids(valid: DataFrame, suffix: str = "row") -> DataFrame:
    """Rename every repeated id after its first row; adds ``renamed``.

    ``suffix='row'`` appends the row number, ``'dup'`` a running count of
    repeats over the whole input. The first row per id is an aggregate, so a
    very frequent id is reduced before the shuffle; ids occurring once never
    take part in the join.
    """
    repeated = valid.groupBy("id").agg(
        F.min("row_num").alias("first_row"), F.count("*").alias("n")
    ).filter("n > 1").drop("n")
    marked = valid.join(repeated, "id", "left").withColumn(
        "renamed", F.coalesce(F.col("row_num") != F.col("first_row"), F.lit(False))
    ).drop("first_row")
    if suffix == "row":
        new = F.concat("id", F.lit("_"), F.col("row_num"))
    else:
        marked = running_total(marked, "row_num", F.col("renamed").cast("bigint"), "_seen")
        new = F.concat("id", F.lit("_dup"), F.col("_seen"))
    return marked.withColumn("id", F.when(F.col("renamed"), new).otherwise(F.col("id"))).drop("_seen")


def load_counters(cleaned: DataFrame) -> DataFrame:
    """One row: loaded, skipped and renamed records."""
    per_id = cleaned.groupBy("id").agg(
        F.count_if("valid").alias("v"), F.count_if(~F.col("valid")).alias("x"))
    return per_id.agg(
        F.coalesce(F.sum("v"), F.lit(0)).alias("loaded"),
        F.coalesce(F.sum("x"), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum(F.greatest(F.col("v") - 1, F.lit(0))), F.lit(0)).alias("renamed"))
