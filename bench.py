"""Headline queries, timed; prints one JSON line.

The stored stages (bars, labels, scores, positions, windows) are dropped first
and their build is timed as its own entry, so no query hides it.
"""

from __future__ import annotations

import json
import os
import time

from tapeloom.plans import fixtures as fx
from tapeloom.plans import model_queries as models
from tapeloom.plans.catalogue import QUERIES
from tapeloom.session import local_session

HEADLINE = (
    "b1_week_ends", "b4_align_to_last_available", "d1_rolling_mean_max_min", "d3_ema", "d18_tail_windows",
    "e24_momentum", "e28_all_factors", "c1_mad_clip", "f1_sector_bars", "f3_context_features", "g1_weekly_labels",
    "h8_universe", "i2_window_summary", "j1_walk_forward_ridge", "l1_industry_neutral", "l7_daily_positions", "m3_nav", "m6_fixed_stops_nav",
    "n1_rank_ic", "n6_turnover", "n11_full_metrics", "o5_environment_strength", "q1_stop_sweep", "s2_event_bars",
)
STAGES = ("bars", "thin_bars", "indices", "weeks", "scores", "labels", "positions", "moves", "factor_windows", "feature_store", "flagged", "context", "model_rows")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    fx.forget()
    seconds = {}
    for stage in STAGES:
        start = time.perf_counter()
        run(getattr(fx if hasattr(fx, stage) else models, stage)(spark, root))
        seconds[f"stage_{stage}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, root))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
