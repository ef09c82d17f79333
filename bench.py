"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8). With names as
arguments only those queries run, with ``--all`` every registered one.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tallymark.catalog import all_queries

HEADLINE = (
    "column_stats", "column_stats_occurrence", "row_diff", "row_diff_first_match", "mismatch_sample", "overlap_summary",
    "reconcile_summary", "null_profile", "duplicate_profile", "rule_results", "find_key", "classify_keys", "transform_chain",
    "filter_and", "cast_columns", "decode_codes", "attribute_by_window", "attribute_cascade", "attribute_by_ids",
    "upsert_results", "latest_per_group", "run_status", "fixed_origin", "redacted_documents", "run_facts", "test_statuses",
    "csv_to_psv", "fixed_width_to_csv",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallymark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    names = [a for a in sys.argv[1:] if a in registered] or list(registered if "--all" in sys.argv else HEADLINE)
    # One throwaway query, so that the first timing does not contain the start of the JVM.
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    for name in names:
        started = time.perf_counter()
        registered[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        spark.catalog.clearCache()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total seconds over the queries", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
