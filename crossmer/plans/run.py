"""From an antigen file to a filled store."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from crossmer import constants as C
from crossmer.functions.statistics import karlin_altschul
from crossmer.operators.nodes import build_nodes, expand_copies
from crossmer.operators.storage import materialize
from crossmer.operators.tags import strip_tags
from crossmer.plans import screen
from crossmer.sources.files import load_sequences
from crossmer.sources.store import ResultStore

Progress = Callable[[str, int], None]


def prepare(records: DataFrame, tag: str | None) -> DataFrame:
    """(ordinal, id, sequence) -> the same with stripped and tag_found."""
    if tag:
        return strip_tags(records, "sequence", tag).select(
            "ordinal", "id", "sequence", "stripped", "tag_found")
    return records.select(
        "ordinal", "id", "sequence", F.upper(F.trim("sequence")).alias("stripped"),
        F.lit(False).alias("tag_found"))


def _finished_nodes(antigens: DataFrame, nodes: DataFrame, done: DataFrame) -> DataFrame:
    """Sequences all of whose copies are completed queries, by their first id."""
    ready = antigens.join(done.select(F.col("query_id").alias("id")), "id", "left_semi")
    counted = ready.groupBy("sequence").agg(F.count("*").alias("ready"))
    return nodes.join(counted, "sequence").filter("ready = copies").select(
        F.col("id").alias("query_id"))


def run_screen(
    spark: SparkSession, input_path: str, store_path: str, tag: str | None = None,
    id_col: str | None = None, seq_col: str | None = None, backend: str = "vectorized",
    kmer_threshold: float = C.JACCARD_THRESHOLD, max_evalue: float = C.MAX_EVALUE,
    min_aligned_len: int = C.MIN_ALIGNED, matrix: str = "blosum62", resume: bool = True,
    prefilter: bool = True, progress: Progress | None = None, verbose: bool = True,
) -> dict:
    """Load, strip, screen and store; returns run statistics.

    With ``resume`` queries that already have stored pairs are skipped. The
    original sequence and tag flag of every antigen are kept.
    """
    started = time.time()
    karlin_altschul(matrix=matrix)  # an unsupported matrix fails before any work
    report = progress or (lambda stage, rows: None)
    records = load_sequences(spark, input_path, id_col, seq_col, verbose=verbose)
    prepared = materialize(prepare(records, tag))
    total, tagged = prepared.agg(F.count("*"), F.count_if("tag_found")).first()
    report("loaded", total)

    store = ResultStore(spark, store_path)
    store.upsert_antigens(prepared)
    # a repeated id means the last record wins, in the store and in the screen
    latest = prepared.groupBy("id").agg(
        F.max_by(F.struct("ordinal", "stripped"), "ordinal").alias("r"))
    antigens = latest.select("id", "r.ordinal", F.col("r.stripped").alias("sequence"))
    nodes = build_nodes(antigens)
    report("distinct", nodes.count)

    done = store.completed_queries() if resume else None
    finished = _finished_nodes(antigens, nodes.frame, done) if resume else None
    if backend == "kmer":
        hits = screen.screen_kmer(
            nodes, max_evalue, min_aligned_len, kmer_threshold, matrix, completed=finished)
    elif backend == "vectorized":
        hits = screen.screen_batch(nodes, max_evalue, prefilter, completed=finished)
    else:
        raise ValueError(f"unknown backend {backend!r}")
    pairs = expand_copies(hits.drop("query_id", "target_id"), antigens, nodes.frame,
                          directed=backend != "kmer")
    if done is not None:
        pairs = pairs.join(done, "query_id", "left_anti")
    found = materialize(pairs.select(*screen.PAIR_COLUMNS))
    pair_count = found.count()
    store.insert_similarities(found)
    report("stored", pair_count)

    meta = {
        "last_run": datetime.datetime.now().isoformat(), "total_antigens": total,
        "total_pairs": pair_count, "db_size_residues": nodes.residues,
    }
    if backend == "vectorized":
        meta["backend"] = "vectorized"
    store.set_meta(**meta)
    return {
        "total_antigens": total, "tag_found": tagged, "total_pairs": pair_count,
        "elapsed_seconds": time.time() - started, "store": store_path,
    }
