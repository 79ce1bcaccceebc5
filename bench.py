"""Time the headline queries.

Prints the JSON line anew after every query, so the last line always holds all that was
measured. A query over $BENCH_LIMIT seconds (default 150) is cancelled and listed under
"stopped"; none is started after $BENCH_TOTAL seconds (default 1200).
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crossmer.queries import all_queries  # noqa: E402

HEADLINE = (
    "clean_load",
    "strip_tag",
    "isoelectric_point",
    "physchem_similarity",
    "align_pair",
    "kmer_jaccard_join",
    "kmer_chain_join",
    "two_pass_candidates",
    "contiguous_match",
    "ra_candidates",
    "ra_candidates_documents",
    "ra_details",
    "live_query",
    "screen_kmer_documents",
    "screen_vectorized_messages",
    "screen_exhaustive",
    "query_similar",
    "export_pairs",
    "index_candidates",
    "screen_vectorized_documents",
)


def _cancel(spark: SparkSession, done: threading.Event, limit: float) -> None:
    """Cancel the jobs of a query that is over its limit, also those it starts afterwards."""
    wait = limit
    while not done.wait(wait):
        spark.sparkContext.cancelAllJobs()
        wait = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("crossmer-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        # alignment is far heavier per byte than a scan: keep small partitions apart
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query
    registered = all_queries()
    limit, total = (float(os.environ.get(n, d)) for n, d in (("BENCH_LIMIT", "150"), ("BENCH_TOTAL", "1200")))
    seconds: dict[str, float] = {}
    stopped: list[str] = []
    began = time.perf_counter()
    for name in sys.argv[1:] or HEADLINE:
        if time.perf_counter() - began > total:
            stopped.append(name)
            continue
        done = threading.Event()
        threading.Thread(target=_cancel, args=(spark, done, limit), daemon=True).start()
        start = time.perf_counter()
        try:
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # noqa: BLE001 - one query must not cost the figures of the others
            stopped.append(name)
            print(f"{name}: {type(error).__name__} after {time.perf_counter() - start:.0f} s", file=sys.stderr, flush=True)
        finally:
            done.set()
        print(json.dumps({
            "metric": "total wall time of headline queries",
            "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
            "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "stopped": stopped,
        }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
