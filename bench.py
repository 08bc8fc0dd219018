"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up the JVM's code paths as a group, then is timed on its own, every row computed.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarnwatch.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "a6_parse_numeric", "c5_vendor_normalise", "c15_wqi_and_class", "c22_cpcb_with_coliform", "d1_first_wins_dedupe",
    "d5_scale_check_on_lineitem", "d5_slot_grid", "e1_hourly_mean", "d7_weather_interpolation", "d12_as_of_raw_readings",
    "d13_interval_totals", "e5_robust_std", "e6_scales_two_level", "e8_monthly_bands", "f6_qc_flags", "f7_trailing_median",
    "f13_reset_capped_ewma", "f14_drift_level", "f15_weather_memory", "g8_incidents", "i6_episode_scores", "c10_air_check", "c21_naqi",
    "e16_daily_metabolism", "h1_hourly_forecast_rows", "h8_sample_features", "e17_conformal_offsets", "j1_hourly_report",
    "j6_accuracy", "k8_weekly_offsets", "k4_isolation_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", os.environ.get("SCRATCH_DIR", "/tmp/tarnwatch-scratch")).config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    for name in names[:3]:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
