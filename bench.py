"""Headline queries timed end to end; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sweepframe.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "asof_nearest_streams", "click_failure_by_state", "stream_extract_json", "flight_profile", "report_bands", "report_cluster_day",
    "wilson_by_cluster", "envelope_fit", "quality_band_fit", "icc_design_effect", "cluster_bootstrap", "condition_correlations",
    "envelope_gate", "pass_report", "event_runs", "threshold_sweep", "greedy_match_prf", "map_50_95", "conf_sweep_f1", "nms_boxes",
    "ensemble_modes", "auroc", "box_contrast", "grid_quality", "dhash_near_duplicates", "track_integrate", "swept_coverage",
    "cluster_sites", "pen_placement", "temporal_confirm", "first_alerts", "dataset_audit", "grouped_split", "forecast_ratings",
    "tgc_corrected", "gaussian_anomaly", "nn_memory_bank", "answer_rubric", "scoring_cache",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sweepframe-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    # Class loading and code generation of a first job are not part of any query.
    QUERIES["asof_coverage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": float(scale.group(1)) if scale else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
