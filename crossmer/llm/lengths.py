"""Exact token-length histogram and its suffix sums (operator 3).

Documents are encoded once and counted by length; everything about context
limits follows from the histogram. For a limit c: a document longer than c keeps
c tokens, so the truncated total is the tokens of documents up to c plus c for
each longer one. The total grows by the number of longer documents per unit of c,
which makes the values between two lengths of the histogram exact as well.

Cases: null and empty texts have length 0 (plus the end id where asked for);
repeated rows count each; an empty table has an empty histogram; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from crossmer.llm.common import arrow_map, table
from crossmer.llm.tokens import default_tokenizer, encoder
from crossmer.operators.storage import materialize

BLOCK = 4096     # lengths per block of the two-level suffix sums


def token_lengths(documents: DataFrame, tokenizer: str | None = None, end_ids: int = 1,
                  text_column: str = "text") -> DataFrame:
    """One row `length` per document."""
    path = tokenizer or default_tokenizer()

    def count(batch: pa.RecordBatch) -> dict:
        ids = encoder(path).encode(batch.column(0).to_pylist())
        return {"length": [len(i) // 4 + end_ids for i in ids]}

    return arrow_map(documents.select(F.col(text_column).alias("text")), count, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs; counted map-side, so the shuffle moves distinct lengths only."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For every length of the histogram, taken as a context limit: what is at, above and below it.

    length, n_docs, docs_longer, tokens_longer, truncated_total, tokens_lost,
    docs_up_to, cumulative_share. Sums run inside blocks of lengths; only one
    row per block takes part in the step over all blocks.
    """
    own = counts.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = (
        own.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
        .select("block",
                F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
                F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
                F.sum("block_docs").over(every).alias("all_docs"),
                F.sum("block_tokens").over(every).alias("all_tokens"))
    )
    later = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    docs_longer = F.coalesce(F.sum("n_docs").over(later), F.lit(0)) + F.col("docs_above")
    tokens_longer = F.coalesce(F.sum("tokens").over(later), F.lit(0)) + F.col("tokens_above")
    return (
        own.join(blocks, "block")
        .withColumn("docs_longer", docs_longer).withColumn("tokens_longer", tokens_longer)
        .withColumn("truncated_total",
                    F.col("all_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer"))
        .select("length", "n_docs", "docs_longer", "tokens_longer", "truncated_total",
                (F.col("all_tokens") - F.col("truncated_total")).alias("tokens_lost"),
                (F.col("all_docs") - F.col("docs_longer")).alias("docs_up_to"),
                ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("cumulative_share"))
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, docs_longer, truncated_total, tokens_lost of any limits, between lengths too."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(c),) for c in limits], "context_limit long")
    first = sums.agg(F.max(F.struct(F.col("docs_up_to"), (F.col("truncated_total") + F.col("tokens_lost")).alias("t"))).alias("a"))
    below = (
        wanted.join(sums, F.col("length") <= F.col("context_limit"), "left")
        .groupBy("context_limit")
        .agg(F.max(F.struct("length", "docs_longer", "truncated_total")).alias("b"))
        .crossJoin(first)      # one row of totals
    )
    longer = F.coalesce(F.col("b.docs_longer"), F.col("a.docs_up_to"), F.lit(0))
    total = F.coalesce(F.col("b.truncated_total"), F.lit(0)) + longer * (
        F.col("context_limit") - F.coalesce(F.col("b.length"), F.lit(0)))
    return below.select("context_limit", longer.alias("docs_longer"), total.alias("truncated_total"),
                        (F.coalesce(F.col("a.t"), F.lit(0)) - total).alias("tokens_lost"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, length: the smallest length that at least this share of the documents does not exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return (
        wanted.join(sums, F.col("cumulative_share") >= F.col("share"), "left")
        .groupBy("share").agg(F.min("length").alias("length"))
    )


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_sums(materialize(histogram(token_lengths(table(spark, folder, "documents")))))
