"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` choose data and cores;
arguments, if any, select queries by name part.
"""

from __future__ import annotations

import json
import os
import sys
import time

from check import session
from panelcast.plans.catalog import QUERIES

HEADLINE = (
    "orders_panel_s5",
    "events_panel_s5",
    "parts_panel_s5",
    "panel_contract_s6",
    "numeric_profile_s7",
    "text_blocks_joined_s8",
    "composition_share_p11",
    "sparse_grid_summary_g1",
    "period_offset_self_join_j10",
    "quantiles_of_hot_groups_a4",
    "pivot_zero_fill_a5",
    "first_rows_per_group_l2",
    "many_lags_w1",
    "stock_with_opening_balance_w8",
    "densify_and_impute_w13",
    "series_regression_m2",
    "autoregression_long_m6",
    "smoothing_free_start_m5",
    "delay_weights_m8",
    "sparse_convolution_m14",
    "stock_flow_m16",
    "dispersion_m24",
    "bootstrap_summary_b2",
    "coherent_total_b3",
    "scenario_paths_b5",
    "rolling_origin_backtest_e5",
    "scoreboard_e6",
    "scoreboard_common_horizon_e6",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    parts = sys.argv[1:]
    names = [n for n in (QUERIES if parts else HEADLINE) if not parts or any(p in n for p in parts)]
    spark = session()
    run(spark, "events_panel_s5", sf_dir)  # start the JVM's and Python's workers
    times = {}
    for name in names:
        times[name] = round(run(spark, name, sf_dir), 3)
        print(f"{times[name]:8.3f} {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "panel_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
