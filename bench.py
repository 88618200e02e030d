"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` picks the data (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "event_hour_bars", "shipment_daily_bars", "session_day_quality", "breakouts", "barrier_outcomes",
    "barrier_excursions", "breakout_hit_rate", "journal_rows", "event_journal_summary", "atr_wilder",
    "daily_volatility", "bars_dedup", "splice_report", "eligibility_counts", "repriced_modes",
    "variant_summary", "regime_summary", "setup_score", "pareto", "equity_curve", "curve_stats",
    "spread_by_session", "spread_entry_weighted", "self_consistency", "bootstrap_interval",
    "null_draw_means", "control_pool_days", "maxt_stepdown", "perm_fdr", "multiplicity", "holdout_verdict",
]


def main() -> None:
    from barloom.catalog import QUERIES
    from barloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "*"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["event_hour_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        rows[name] = len(QUERIES[name](spark, sf_dir).toPandas())
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows": rows, "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
