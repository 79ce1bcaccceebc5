"""A query set against a stored k-mer index.

The index is a bucketed table: postings (k-mer, node, size of the node's k-mer set)
clustered and sorted by k-mer. Sequences are added batch by batch, each batch as
further files of the buckets, so nothing stored is read or written again. A search
deals the queries' postings out to the same buckets; the stored side is joined as it
lies, without a shuffle.

A pair is found where both sides have a k-mer. Distinct postings are joined, so the
rows of a pair are the shared k-mers: with both set sizes they give the Jaccard index,
and any row at all means a common run of k residues. The two-pass filter of the
default settings (6-mers, chains of three 4-mers) needs no second join.

A k-mer that would make more than CELL_PAIRS pairs is counted out beforehand and joined
as a grid of cells, with a shuffle of its postings alone. Where the queries have at most
BROADCAST_KEYS distinct k-mers, stored postings of other k-mers are neither counted nor sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crossmer import constants as C
from crossmer.kernels.kmers import distinct_kmers
from crossmer.operators.grid import BROADCAST_KEYS, CELL_PAIRS, hot_keys, list_join
from crossmer.operators.storage import materialize, new_path

BUCKETS = 64
LETTERS = 1 << 20       # of the sequences whose postings are made at a time


class KmerIndex:
    """Postings of node sequences (node, sequence) under a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str | None = None, k: int = C.KMER_K, buckets: int = BUCKETS):
        self.spark, self.k, self.buckets = spark, k, buckets
        self.path = path or new_path(spark, "index")
        self.table = f"kmer_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (kmer STRING, node BIGINT, size INT) USING parquet "
            f"CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def postings(self, sequences: DataFrame) -> DataFrame:
        """kmer, node, size: one row per distinct k-mer of a sequence."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node, texts = batch.column(0), [text or "" for text in batch.column(1).to_pylist()]
                upto = np.cumsum([len(text) for text in texts])
                at = 0
                while at < len(texts):
                    end = max(int(np.searchsorted(upto, upto[at] - len(texts[at]) + LETTERS, "right")), at + 1)
                    row, kmer = distinct_kmers(texts[at:end], k)
                    size = np.bincount(row, minlength=end - at).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [kmer, node.slice(at, end - at).take(pa.array(row)), pa.array(size[row])], names=["kmer", "node", "size"])
                    at = end

        return sequences.select(F.col("node").cast("long").alias("node"), "sequence").mapInArrow(run, "kmer string, node long, size int")

    def add(self, sequences: DataFrame) -> KmerIndex:
        """Append a batch of new nodes."""
        rows = self.postings(sequences).repartition(self.buckets, "kmer")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "kmer").sortBy("kmer").saveAsTable(self.table)
        return self

    def stored(self) -> DataFrame:
        return self.spark.table(self.table)

    def frequencies(self) -> DataFrame:
        """kmer, nodes: in how many sequences a k-mer occurs; counted bucket by bucket."""
        return self.stored().groupBy("kmer").agg(F.count("*").alias("nodes"))

    def _shared(self, queries: DataFrame, pairs: int | None = None) -> DataFrame:
        """q_node, t_node, q_size, t_size, shared of every pair with a common k-mer."""
        pairs = pairs or CELL_PAIRS
        asked = materialize(self.postings(queries).repartition(self.buckets, "kmer"))
        stored, keys = self.stored(), asked.select("kmer").distinct()
        if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:       # only postings that are asked for are counted and sorted
            stored = stored.join(F.broadcast(keys), "kmer", "left_semi").select("kmer", "node", "size")
        hot = materialize(hot_keys(stored, asked, "kmer", pairs).select("kmer"))
        ends = [F.col("r.node").alias("q_node"), F.col("l.node").alias("t_node"),
                F.col("r.size").alias("q_size"), F.col("l.size").alias("t_size")]
        cold = asked
        if not hot.isEmpty():
            cold = asked.join(hot, "kmer", "left_anti")
        dealt = cold.repartition(self.buckets, "kmer")         # as the buckets are: only this side is shuffled
        found = stored.alias("l").hint("merge").join(dealt.alias("r"), F.col("l.kmer") == F.col("r.kmer")).select(*ends)
        if cold is not asked:
            few = [side.join(hot, "kmer", "left_semi") for side in (stored, asked)]
            found = found.unionByName(list_join(*few, "kmer", F.lit(True), pairs).select(*ends))
        return found.groupBy("q_node", "t_node", "q_size", "t_size").agg(F.count("*").alias("shared"))

    def jaccard(self, queries: DataFrame, threshold: float = C.JACCARD_THRESHOLD) -> DataFrame:
        """q_node, t_node, jaccard of the stored sequences with an overlap of at least `threshold`."""
        return _scored(self._shared(queries)).filter((F.col("jaccard") >= threshold) & (F.col("jaccard") > 0))

    def common_runs(self, queries: DataFrame) -> DataFrame:
        """q_node, t_node of the stored sequences with a common run of at least k residues."""
        return self._shared(queries).select("q_node", "t_node")

    def two_pass(self, queries: DataFrame, threshold: float = C.JACCARD_THRESHOLD) -> DataFrame:
        """Pairs by overlap with their Jaccard index, pairs by a common run alone with 0."""
        score = F.when(F.col("jaccard") >= threshold, F.col("jaccard")).otherwise(F.lit(0.0))
        return _scored(self._shared(queries)).select("q_node", "t_node", score.alias("jaccard"))

    def drop(self) -> None:
        """Forget the table; its files are deleted with the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _scored(pairs: DataFrame) -> DataFrame:
    union = F.col("q_size") + F.col("t_size") - F.col("shared")
    return pairs.select("q_node", "t_node", (F.col("shared") / union).alias("jaccard"))
