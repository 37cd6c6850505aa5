"""Headline queries, each from the raw tables with a cold cache; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 1). Before measuring, every query runs once on the smallest sample tables, if
they lie beside the measured ones, to compile the JVM's code; nothing is cached between runs.
"""

import json
import os
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from pyspark.sql import SparkSession  # noqa: E402

from custlattice.plans.registry import QUERIES  # noqa: E402

HEADLINE = (
    "enrich_transcript_sentiment",
    "run_all_enrichment",
    "customer_events",
    "customer_moments",
    "customer_health",
    "health_by_segment",
    "nba_generate",
    "nba_record_outcome",
    "customer_360",
    "customer_timeline",
    "evidence_search",
    "evidence_index",
    "action_evidence",
    "sem_view",
    "retention_metrics",
    "check_customer",
)


def run(spark, directory, name):
    """Seconds to plan and run the whole query; the result goes to a sink that discards it."""
    start = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    spark.catalog.clearCache()
    return seconds


def main():
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("custlattice-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="custlattice-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(directory.rstrip("/")), "sf0.001")
    for n in names if os.path.isdir(small) else ():
        run(spark, small, n)
    seconds = {n: round(statistics.median(run(spark, directory, n) for _ in range(runs)), 3) for n in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
