"""Live search of one sequence, or of a set, against all stored antigens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from crossmer import constants as C
from crossmer.functions import statistics as S
from crossmer.functions.sequence import self_score
from crossmer.functions.statistics import significance
from crossmer.operators.indexed import KmerIndex
from crossmer.operators.nodes import NodeSet, attach
from crossmer.operators.scoring import align_pair
from crossmer.operators.storage import materialize


def live_query(sequence: str, nodes: NodeSet, antigens: DataFrame, max_evalue: float = C.MAX_EVALUE,
               min_aligned_len: int = C.MIN_ALIGNED, top_n: int = C.CLI_TOP_N,
               query_id: str = "<query>") -> DataFrame:
    """Top antigens of one sequence, best E-value first, then in input order.

    The query is a literal, so the search is one pass over the distinct
    sequences. The best ``top_n`` antigens belong to the best ``top_n`` of these,
    whose copies are then looked up.
    """
    pairs = nodes.frame.select(
        F.lit(query_id).alias("query_id"), F.col("id").alias("target_id"),
        F.col("node").alias("ordinal"), "copies",
        F.lit(sequence.strip().upper()).alias("query_seq"), F.col("sequence").alias("target_seq"))
    hits = align_pair(pairs, "query_seq", "target_seq", nodes.residues).filter(
        (F.col("evalue") <= max_evalue) & (F.col("aligned_region_len") >= min_aligned_len))
    sequences = hits.orderBy("evalue", "ordinal").limit(top_n).drop("target_id", "ordinal")
    copies = antigens.select(F.col("id").alias("target_id"), "ordinal", "sequence").join(
        F.broadcast(sequences), F.col("sequence") == F.col("target_seq")).drop("sequence")     # at most top_n rows
    best = copies.orderBy("evalue", "ordinal").limit(top_n)
    # at most top_n rows are left, so ranking them in one task is safe
    return best.withColumn("rank", F.row_number().over(W.orderBy("evalue", "ordinal"))).withColumn(
        "significance", significance(F.col("evalue")))


def live_queries(queries: DataFrame, index: KmerIndex, nodes: NodeSet, antigens: DataFrame,
                 max_evalue: float = C.MAX_EVALUE, min_aligned_len: int = C.MIN_ALIGNED,
                 top_n: int = C.CLI_TOP_N) -> DataFrame:
    """Top antigens of every query (node, sequence) among those with a common k-mer.

    ``index`` holds ``nodes``, the distinct sequences of ``antigens``. New
    sequences are searched without screening the stored ones again. A pair
    whose smaller self-score cannot reach the E-value is not aligned. Of a
    query's sequences, and of a sequence's copies, at most the first ``top_n``
    can be among its ``top_n`` antigens, so each is ranked and cut before the two
    meet. Columns as in `live_query`, with ``q_node``.
    """
    lam, k, h = S.karlin_altschul()
    asked = queries.select(F.col("node").alias("q_node"), F.upper(F.trim("sequence")).alias("query_seq"))
    pairs = attach(index.common_runs(asked.select(F.col("q_node").alias("node"), F.col("query_seq").alias("sequence"))),
                   nodes.frame, ["sequence"], sides=("t",)).join(asked, "q_node").withColumnRenamed("t_sequence", "target_seq")
    most = F.least(self_score(F.col("query_seq")), self_score(F.col("target_seq")))
    possible = S.evalue(most, F.length("query_seq"), nodes.residues, lam, k, h)
    hits = align_pair(pairs.filter(possible <= max_evalue), "query_seq", "target_seq", nodes.residues).filter(
        (F.col("evalue") <= max_evalue) & (F.col("aligned_region_len") >= min_aligned_len))
    first = lambda frame, place, by, *order: frame.withColumn(
        place, F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col(place) <= top_n)
    sequences = materialize(first(hits, "rank", "q_node", "evalue", "t_node").drop("rank", "query_seq"))
    named = antigens.select(F.col("id").alias("target_id"), "ordinal", F.col("sequence").alias("target_seq")).join(
        sequences.select("target_seq").distinct(), "target_seq", "left_semi")      # only antigens that were hit are sorted
    copies = first(named, "place", "target_seq", "ordinal").drop("place")
    return first(sequences.join(copies, "target_seq"), "rank", "q_node", "evalue", "ordinal").withColumn(
        "significance", significance(F.col("evalue"))).drop("target_seq")
