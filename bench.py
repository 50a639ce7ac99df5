"""Time the headline queries: one warm-up run, then the median of three, results computed in full but not collected.

Reads $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.
"""

import json
import os
import statistics
import time

from stayframe.queries import QUERIES
from stayframe.session import local_session

HEADLINE = [
    "a1_csv_scan",
    "c2_avg_price_by_bedrooms",
    "c3_summary",
    "c4_profile",
    "c4_top_values",
    "d1_feature_lookup",
    "d1_lookup_many_to_one",
    "d1_lookup_few_keys",
    "e6_query_old_version",
    "f5_overwrite_grows",
    "f8_training_set",
    "f8_training_in_place",
    "f12_score_batch",
    "g1_mean_fill",
    "g6_categories",
    "h1_linear_regression",
    "h6_errors",
    "h7_importances",
    "i1_cross_validation",
    "i2_primary_metrics",
    "i5_correlations",
    "j1_runs_table",
    "j1_open_metrics",
    "j2_latest_run_per_experiment",
    "k1_version_numbers",
    "k7_deleted_models",
    "k4_archived_stages",
    "t3_tracking_rows",
]
# Full-size tree models: run once, without a warm-up.
LONG = ["h2_random_forest", "h3_boosted_trees", "h12_compare_parameters"]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))

    def seconds(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    timings = {}
    for name in HEADLINE:
        seconds(name)
        timings[name] = round(statistics.median(seconds(name) for _ in range(RUNS)), 3)
    for name in LONG:
        timings[name] = round(seconds(name), 3)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": timings, "sf": scale}))


if __name__ == "__main__":
    main()
