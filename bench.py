"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query writes its whole result to a no-op sink; one small query warms the JVM first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "psi_numerical_lineitem", "psi_breakdown_lineitem", "psi_categorical_lineitem",
    "quantile_edges_lineitem", "histogram_lineitem", "ks_lineitem", "chi2_lineitem",
    "numeric_profile_lineitem", "categorical_profile_orders", "baseline_build_lineitem",
    "reference_sample_orders", "feature_drift_lineitem", "prediction_drift_lineitem",
    "segment_drift_events", "window_drift_events", "quality_report", "drift_run_summary",
    "harmonize_orders", "validate_orders", "alert_candidates", "retrain_decision",
    "training_set", "stratified_split", "heuristic_score", "binary_metrics",
    "champion_challenger", "close_pending_job",
)


def main() -> None:
    from siltmark.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("siltmark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["psi_numerical_lineitem"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline drift-monitoring queries, total wall time",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
