"""Headline timings: one JSON line, seconds per query and in total."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from aridscape.session import build_session  # noqa: E402
from registry import QUERIES  # noqa: E402

HEADLINE = [
    "r07_monthly_median",
    "r17_seasonal_amplitude",
    "g04_horn_gradients",
    "g09_rasterize",
    "g10_distance",
    "g12_focal_mean",
    "g01_regrid_bilinear",
    "n01_percentile_minmax",
    "a02_eigen_weights",
    "o03_weighted_overlay",
    "o07_sensitivity",
    "o08_natural_breaks",
    "o12_class_summary",
    "d04_spi",
    "d07_events",
    "m02_leave_one_out",
    "f07_benchmark",
    "v01_rank_correlation",
    "v06_operational_test",
    "v11_historical_spi",
    "y04_detrended_anomaly",
    "l01_training_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed pass over a small query pays for JVM and Python worker start-up
    QUERIES["a02_eigen_weights"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
