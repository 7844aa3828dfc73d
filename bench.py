"""Headline queries on one machine: prints one line of JSON with their seconds.

BENCH_SF_DIR: the tables (default sf0.1); BENCH_CPUS: cores (default all).  Each query is run once to
warm up and then five times in rotating order, and its median counts.  What is timed is the whole
query, written to Spark's noop sink; ``mset_last_wins`` and ``store_compaction`` include writing to a store.
``stored_prefix`` and ``stored_range`` read from a store that is filled and compacted before, so that files are skipped by key.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from strandline.operators import scan
from strandline.queries.mappings import NOW_MS
from strandline.queries.registry import QUERIES, filled

HEADLINE = ["reductions_prefix", "count_everything", "sum_range", "avg_prefix", "min_range", "max_prefix", "newest_wins", "last_price_by_part", "mget_ordered", "exists_batch", "range_series", "prefix_empty", "incr_counts", "script_fold", "compact_equivalence", "delete_status", "mset_last_wins", "store_compaction"]
RUNS = 5


def stored(spark: SparkSession, sf_dir: str) -> dict:
    """Reads of the events in a compacted store."""
    store = filled(spark, sf_dir)
    store.compact("default", NOW_MS)
    return {
        "stored_prefix": lambda s, d: scan.scan_prefix(store.live("default", NOW_MS), "click:000000001"),
        "stored_range": lambda s, d: scan.scan_range(store.live("default", NOW_MS), "click:0000000010", "click:0000000100"),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    partitions = str(os.cpu_count() if cpus == "*" else cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {q: QUERIES[q] for q in HEADLINE} | stored(spark, sf_dir)
    names, times = list(queries), {q: [] for q in queries}
    for turn in range(RUNS + 1):
        for k in range(len(names)):
            name = names[(k + 5 * turn) % len(names)]
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if turn:
                times[name].append(time.perf_counter() - began)
    medians = {q: round(statistics.median(t), 4) for q, t in times.items()}
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(medians.values()), 4), "unit": "sec", "queries": medians, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
