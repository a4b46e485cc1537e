"""Time the headline queries on local Spark; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. Every query runs in full
into a sink that discards rows, three times; the median counts, so code is compiled and files are
cached for all alike.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from parcelweave.plans.catalog import QUERIES
from parcelweave.session import configure

HEADLINE = (
    "page_title_by_host", "page_profile", "css_nav_links", "parse_pages", "selector_coverage",
    "mapped_customers", "document_titles", "validation_errors", "bulk_load", "csv_source", "jsonl_source",
    "last_write_wins", "upsert_merge", "duplicate_keys", "consolidated_parcels", "content_dedup", "raw_manifest",
    "next_tasks", "next_tasks_per_platform", "queue_stats", "task_state_fold", "frontier_expand", "ripple_2hop",
    "task_priority", "delinquency_score", "due_parcels", "hotspot", "strategy_mix", "seeded", "rate_slots",
    "running_level", "success_rate_5m", "runtime_quantiles", "throughput_sliding", "range_stats", "queue_rollup",
    "notification_outbox", "signed_outbox", "stream_metrics", "stream_upsert", "stream_signal_join",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("parcelweave-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "event_counts", sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(3)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "csv_rows_per_sec": round(parts / seconds["csv_source"]),
        "pages_per_sec": round(pages / seconds["parse_pages"]),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
