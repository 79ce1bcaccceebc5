"""Command line: run, query, export, stats, help-scores."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession, functions as F

from crossmer import constants as C
from crossmer.functions.statistics import format_evalue_text, significance

SCORE_GUIDE = """
  E-value: alignments this good expected by chance in a collection of this size.
    < 1e-10         very high
    1e-10 - 1e-4    strong
    1e-4  - 0.1     moderate
    0.1   - 1.0     weak
    > 1.0           not significant
  The same raw score has a larger E-value in a larger collection.

  Bit score: the raw score on a scale that does not depend on the collection.
    > 50      very strong similarity
    30 - 50   strong
    20 - 30   moderate
    < 20      weak or none

  Scoring: BLOSUM62, gap open 10 (first position), gap extend 1 (each further one)
"""


START = """crossmer compares every antigen of a file with every other one.

  1. crossmer run --input antigens.csv --db store      screen a file
  2. crossmer query --db store --id AG1                partners of one antigen
  3. crossmer query --db store --seq ACDEFGHIKL        search with any sequence
  4. crossmer export --db store                        all pairs as CSV
"""


def session() -> SparkSession:
    return SparkSession.builder.appName("crossmer").getOrCreate()


def duration(seconds: float) -> str:
    """Seconds, minutes or hours, as shown in progress reports."""
    if seconds < 60:
        return f"{seconds:.0f}s"
    return f"{seconds / 60:.1f}min" if seconds < 3600 else f"{seconds / 3600:.1f}hr"


def _open(path: str):
    from crossmer.sources.store import ResultStore

    store = ResultStore(session(), path)
    if not store.exists():
        print(f"{path} is not a store")
        sys.exit(1)
    return store


def cmd_run(args) -> None:
    from crossmer.plans.run import run_screen

    if args.backend == "vectorized":
        for flag, default in (("min_aligned", C.MIN_ALIGNED), ("matrix", "blosum62"),
                              ("kmer_threshold", C.JACCARD_THRESHOLD)):
            if getattr(args, flag) != default:
                print(f"Warning: --{flag.replace('_', '-')} has no effect on this backend")
    stats = run_screen(
        session(), args.input, args.db, args.tag, args.id_col, args.seq_col, args.backend,
        args.kmer_threshold, args.max_evalue, args.min_aligned,
        args.matrix if args.backend == "kmer" else "blosum62",
        not args.no_resume, not args.no_prefilter,
        progress=lambda stage, rows: print(f"  {stage}: {rows:,}"))
    print(f"  Antigens screened: {stats['total_antigens']:,} (tag found: {stats['tag_found']:,})")
    print(f"  Similar pairs found: {stats['total_pairs']:,}")
    print(f"  Total time: {duration(stats['elapsed_seconds'])}, results in {args.db}")


def cmd_query(args) -> None:
    from crossmer.operators.scoring import batch_align
    from crossmer.operators.tags import strip_tags

    store = _open(args.db)
    shown = [significance(F.col("evalue")).alias("significance"),
             format_evalue_text(F.col("evalue")).alias("e_text")]
    if args.id:
        rows = store.query_similar(args.id, args.max_evalue, args.top_n).select("*", *shown).collect()
        partner = "partner_id"
    else:
        probe = store.spark.createDataFrame([(args.seq,)], "sequence string")
        sequence = args.seq.strip().upper()
        if args.tag:
            sequence = strip_tags(probe, "sequence", args.tag).first()["stripped"]
        candidates = store.get_all_stripped().select(
            "id", F.col("stripped").alias("sequence"), F.col("id").alias("ordinal"))
        rows = batch_align(
            sequence, candidates, "<query>", args.max_evalue, args.min_aligned,
            store.total_residues()).limit(args.top_n).select("*", *shown).collect()
        partner = "target_id"
    if not rows:
        print("  nothing reaches the E-value asked for")
        return
    print(f"  {'#':<5} {'antigen':<25} {'E':<12} {'bits':<10} {'class':<16} aligned to")
    for rank, row in enumerate(rows, 1):
        extra = ""
        if args.id and row["pc_composite_score"] is not None:
            extra = f"  {row['pc_composite_score']:.3f}  {row['detection_source'] or ''}"
        print(f"  {rank:<5} {row[partner]:<25} {row['e_text']:<12} {row['bit_score']:<10.1f} "
              f"{row['significance']:<16} {row['aligned_region_len']}{extra}")
    print(f"\n  First hit, {rows[0][partner]}:")
    for name, value in rows[0].asDict().items():
        if value is not None and name not in (partner, "e_text"):
            print(f"    {name.replace('_', ' ')}: {value:.4g}" if isinstance(value, float) else f"    {name.replace('_', ' ')}: {value}")


def cmd_export(args) -> None:
    store = _open(args.db)
    output = args.output or f"{args.db.rstrip('/')}.csv"
    print(f"{store.export_csv(output, args.max_evalue):,} pairs written to {output}")


def cmd_stats(args) -> None:
    store = _open(args.db)
    print(f"  antigens: {store.antigen_count():,} with {store.total_residues():,} residues")
    print(f"  stored pairs: {store.similarity_count():,}")
    print(f"  latest screen: {store.get_meta('last_run') or 'none recorded'}")
    size = store.get_meta("db_size_residues")
    if size:
        print(f"  search space of that screen: {int(size):,} residues")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crossmer", description="Sequence similarity screening on Spark")
    sub = top.add_subparsers(dest="command")

    run = sub.add_parser("run", help="screen all antigens of a file against each other")
    run.add_argument("--input", required=True)
    run.add_argument("--db", required=True, help="store folder")
    run.add_argument("--tag", help="N-terminal tag to strip")
    run.add_argument("--id-col")
    run.add_argument("--seq-col")
    run.add_argument("--kmer-threshold", type=float, default=C.JACCARD_THRESHOLD)
    run.add_argument("--max-evalue", type=float, default=C.MAX_EVALUE)
    run.add_argument("--min-aligned", type=int, default=C.MIN_ALIGNED)
    run.add_argument("--matrix", default="blosum62", choices=["blosum62", "blosum45", "blosum80"])
    run.add_argument("--no-resume", action="store_true")
    run.add_argument("--backend", default="vectorized", choices=["vectorized", "kmer"])
    run.add_argument("--no-prefilter", action="store_true")
    run.set_defaults(func=cmd_run)

    query = sub.add_parser("query", help="look up one antigen or align one sequence")
    query.add_argument("--db", required=True)
    what = query.add_mutually_exclusive_group(required=True)
    what.add_argument("--id")
    what.add_argument("--seq")
    query.add_argument("--tag")
    query.add_argument("--max-evalue", type=float, default=C.MAX_EVALUE)
    query.add_argument("--min-aligned", type=int, default=C.MIN_ALIGNED)
    query.add_argument("--top-n", type=int, default=C.CLI_TOP_N)
    query.set_defaults(func=cmd_query)

    export = sub.add_parser("export", help="write stored pairs as CSV")
    export.add_argument("--db", required=True)
    export.add_argument("--output")
    export.add_argument("--max-evalue", type=float, default=C.EXPORT_MAX_EVALUE)
    export.set_defaults(func=cmd_export)

    stats = sub.add_parser("stats", help="store statistics")
    stats.add_argument("--db", required=True)
    stats.set_defaults(func=cmd_stats)

    sub.add_parser("help-scores", help="how to read the scores").set_defaults(
        func=lambda _args: print(SCORE_GUIDE))
    return top


def main(argv: list[str] | None = None) -> None:
    top = parser()
    args = top.parse_args(argv)
    if not args.command:
        print(START)
        top.print_help()
        return
    started = time.perf_counter()
    args.func(args)
    print(f"\nCompleted in {time.perf_counter() - started:.3f}s")
