"""Antigen frames derived from the text tables.

The tables hold prose, not proteins. Two readings of a text are used, always
over every row and the whole text:

* letters: the line with all non-residue letters removed, as the file loaders
  do it;
* words: one residue per word, so that a copied passage of six words is a
  shared 6-mer and near copies of a line are homologs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossmer import constants as C
from crossmer.operators.storage import spread
from crossmer.functions.sequence import clean_sequence, is_valid_sequence, word_residues

POSITIONS = 1 << 28        # lines of a document or turns of a conversation; more are refused


def input_order(owner: str, position: str) -> Column:
    """A unique number per (owner, position), in that order."""
    too_many = F.raise_error(F.concat(F.lit(f"{owner} "), F.col(owner), F.lit(" has too many parts"))).cast("bigint")
    return F.when(F.col(position) < POSITIONS, F.col(owner) * POSITIONS + F.col(position)).otherwise(too_many)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, name).select(*columns))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, lang, id, ordinal, pos, line: one row per line of every document."""
    return (
        text_table(spark, folder, "documents", "doc_id", "source", "lang", "text")
        .select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("id", F.concat(F.lit("D"), F.col("doc_id"), F.lit(":"), F.col("pos")))
        .withColumn("ordinal", input_order("doc_id", "pos"))
    )


def letter_antigens(spark: SparkSession, folder: str) -> DataFrame:
    """Valid antigens from the letters of every document line."""
    return (
        document_lines(spark, folder)
        .select("id", "ordinal", "doc_id", "pos", clean_sequence(F.col("line")).alias("sequence"))
        .filter(is_valid_sequence(F.col("sequence")))
    )


def word_antigens(spark: SparkSession, folder: str) -> DataFrame:
    """Valid antigens from the words of every document line."""
    return (
        document_lines(spark, folder)
        .select("id", "ordinal", "doc_id", "pos", "source", "lang",
                word_residues(F.col("line")).alias("sequence"))
        .filter(F.length("sequence") >= C.MIN_SEQUENCE_LENGTH)
    )


def message_antigens(spark: SparkSession, folder: str) -> DataFrame:
    """Valid antigens from the words of every conversation message."""
    return (
        text_table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
        .select(
            F.concat(F.lit("C"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("id"),
            input_order("conv_id", "turn").alias("ordinal"),
            "conv_id", "turn", "role",
            word_residues(F.translate("text", "\n", " ")).alias("sequence"),
        )
        .filter(F.length("sequence") >= C.MIN_SEQUENCE_LENGTH)
    )


def item_antigens(spark: SparkSession, folder: str) -> DataFrame:
    """Valid antigens from the letters of every benchmark item."""
    return (
        table(spark, folder, "benchmark")
        .select(
            F.concat(F.lit("B"), F.col("item_id")).alias("id"),
            F.col("item_id").alias("ordinal"),
            clean_sequence(F.col("text")).alias("sequence"),
        )
        .filter(is_valid_sequence(F.col("sequence")))
    )
