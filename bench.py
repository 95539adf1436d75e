"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.catalogue import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "merge_units",
    "count_sessions",
    "count_items",
    "count_items_without_title",
    "count_items_without_description",
    "count_resolutions",
    "count_votes",
    "count_duplicate_items",
    "unit_metrics",
    "decision_report",
    "maturity_report",
    "session_timestamp_report",
    "last_harvest_report",
    "match_rate",
    "reports_to_quads",
    "harvest_titles",
    "unit_bodies",
    "nquads_roundtrip",
    "delete_subjects",
    "replace_properties",
    "norm_label",
)


def run(spark: SparkSession, name: str) -> float:
    """Seconds to compute every row and column of a query."""
    started = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("graphreports-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "session_timestamp_report")  # starts the JVM's compilers and the Python workers
    seconds = {name: round(run(spark, name), 3) for name in HEADLINE}
    spark.stop()
    scale = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
