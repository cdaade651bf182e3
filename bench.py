"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_REPEAT the runs per query (the median
counts). One short query warms the session up first.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from contract.queries import REGISTRY
from lendscape.session import drop_stored

HEADLINE = [
    "bad_rate_by_app_month",
    "loans_dpd",
    "clean_attributes",
    "clean_financials",
    "gold_feature_store",
    "latest_default_label",
    "bad_rate_by_num_loans",
    "bad_rate_by_occupation",
    "bad_rate_by_loan_type",
    "bad_rate_by_click_bucket",
    "numeric_profile",
    "correlation_rank",
    "customer_overlap",
    "fitted_medians",
    "target_encoding_map",
    "auc_by_month",
    "monitoring_table",
    "univariate_auc",
    "backfill_store",
    "split_evaluation",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lendscape-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Seconds from the call to the last row, everything built and discarded."""
    began = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    run(spark, "bad_rate_by_app_month", sf_dir)
    seconds = {n: round(statistics.median(run(spark, n, sf_dir) for _ in range(repeat)), 3) for n in names}
    drop_stored(spark)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
