"""Time the headline queries; prints one JSON line.

Each query is built and run to the end with its result discarded (the `noop` sink), so
the time covers planning, scan, shuffles and the last row. A short warm-up on the
smallest tables takes the JVM's start out of the first number.
"""

from __future__ import annotations

import json
import os
import time

from runlens.session import local_session
from runlens.workloads.queries import QUERIES

HEADLINE = [
    "prepare_ts", "prepare_scalar", "latest_runs", "removals_by_sector", "retention_median",
    "ratio_all", "ratio_all_dq", "residuals", "relative_error_all", "percent_bias",
    "event_year_ratio", "f_over_fmsy_ratio", "stat_lines", "ratio_ribbon_f", "ratio_ribbon_biomass",
    "terminal_ribbon_f", "level_ribbon", "event_year_match", "residual_share", "mean_t_interval",
    "iteration_mean_bias", "self_reference_median", "boxplot_relative_error", "median_interval95",
    "bias_interval95", "event_histogram", "compare_iterations", "at_age_median", "index_median",
    "length_plan", "balanced_random_schedule", "report_table",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("ratio_ribbon_f", "boxplot_relative_error"):
            run(spark, name, small)
    times = {name: round(run(spark, name, sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "ensemble_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
