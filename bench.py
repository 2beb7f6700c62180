"""Headline queries timed end to end (plan, run, write to a sink that keeps nothing). Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boxlens.plans.catalogue import QUERIES  # noqa: E402
from boxlens.session import build_session  # noqa: E402

HEADLINE = [
    "C1_overlap_pairs", "C2_greedy_one_to_one", "C5_evaluate", "C8_separation", "C12_nearest_box", "C13_near_pairs", "D3_ledger_metrics", "D4_summarize",
    "D13_shape_percentiles", "D18_threshold_sweep", "D19_grid_search", "E1_bootstrap_poisson", "E1_bootstrap_ci", "E6_auc", "E8_cut_table",
    "E13_calibrate_threshold", "E16_stratified_systematic_split", "R7_quality", "R14_components", "R17_cell_features", "R23_line_score", "R25_hysteresis", "R28_guided_filter",
    "R35_row_robust_z",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, shuffle_partitions=max(8, int(cpus)) if cpus.isdigit() else 8, app="bench")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    picks = sys.argv[1:] or HEADLINE
    times = {}
    for name in picks:
        t0 = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
