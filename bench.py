"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores. Every
query is run to the end through the no-op sink, so all rows are produced; the best of two runs
after one warm-up is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # dataset build: parse, wrap, band, trip window, joins
    "f01_parse_times", "f02_delay_wrap", "f09_utc_hour", "p08_band_or_null",
    "w01_lag_by_day_trip", "w01_lag_hot_keys", "w01_class_profile", "w03_position_zero_based", "w05_distance_in_trip",
    "j01_public_holidays", "j03_nearest_station", "j04_nearest_road_box", "j05_hourly_weather", "j06_traffic_inner",
    "j07_region_filter", "j11_last_per_key", "build_events_features",
    # statistics and quality
    "a06_count_distinct", "a08_group_and_global_mean", "a09_median_by_key", "a13_pivot_mean_filled", "a18_class_summary",
    "q02_completeness", "q05_ranges", "q10_distributions",
    # samples and splits
    "x01_sample_exact", "x02_sample_stratified", "x04_train_test_exact", "x07_stratified_folds",
    # stages and models
    "e06_first_appearance_codes", "e07_historical_mean", "e16_fit_on_train_only", "m01_ridge_one_feature", "m10_log_target",
    "m02_boosted_stump", "m05_single_split_classes", "m08_stacked_ridges",
    # files and increments
    "s01_mixed_headers", "r03_incremental_lag",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE

    from lateline.plans.catalog import QUERIES
    from lateline.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    for name in wanted:
        best = None
        for run in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run:
                best = took if best is None else min(best, took)
        times[name] = round(best, 4)
        print(f"{name} {best:.3f}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total_headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
