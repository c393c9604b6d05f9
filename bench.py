"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
"""

import json
import os
import time

from pyspark.sql import SparkSession

from tallyflow.plans.catalog import QUERIES

HEADLINE = (
    "running_history",
    "history_from_state",
    "batch_metrics",
    "rejected_rows",
    "full_scan_stats",
    "reconciliation",
    "recent_history",
    "orders_running_history",
    "shipments_running_history",
    "csv_roundtrip_history",
    "stream_ingest_state",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed pass loads classes, so that the first query does not pay for all.
    QUERIES["running_history"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": int(cpus),
        "spark": spark.version,
        "chunk_size": {"events": 10, "orders": 100},
        "ingest_rows_per_sec": round(rows / seconds["csv_roundtrip_history"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
