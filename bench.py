"""Time headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS select data and cores.

Each figure is also told on the error stream as it comes, and a stop from outside prints the line with what there is.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

from lodgemetrics.plans import build_catalog
from lodgemetrics.session import get_session

HEADLINE = [
    "kpi_total", "kpi_by_hotel", "monthly_revenue_mom", "top_countries_by_revenue", "booking_cube", "standardize",
    "dedup_by_key", "build_fact_monthly_warehouse", "build_fact_daily_context", "revpar_bridge", "cy_vs_py",
    "adr_occ_quadrant", "room_type_both_sides", "cancel_by_lead_deposit", "boxplot_stats", "hash_sample_topn",
    "adr_stats_by_month", "weekend_premium_by_segment", "room_shift_taxonomy", "rolling_median_by_lead", "mann_whitney",
    "cramers_v_all", "spearman_vs", "holdout_metrics", "pick_elasticity", "price_grid_optimize", "scenario_by_month",
    "dual_optimize", "threshold_sweep_global", "roc_auc", "overbooking_buffer_market_segment",
]
#: Fits come last, under names of their own, and do not count in the total of the headline queries.
FITS = ["fit_rf", "fit_gbt"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    fits: dict[str, float] = {}

    def report() -> None:
        print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                          "queries": times, "fits": fits, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}),
              flush=True)

    def stopped(*_) -> None:
        report()
        os._exit(1)

    signal.signal(signal.SIGTERM, stopped)
    plans = build_catalog().plans
    plans["kpi_total"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for names, into in ((HEADLINE, times), (FITS, fits)):
        for name in names:
            start = time.perf_counter()
            plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - start, 3)
            print(name, into[name], file=sys.stderr, flush=True)
    report()


if __name__ == "__main__":
    main()
