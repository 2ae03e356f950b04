"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "price_position_score",
    "opportunity_score",
    "resilience_score",
    "screening_snapshot",
    "history_h",
    "slow_variables",
    "veto_flags",
    "watchlist",
    "sector_heat",
    "market_cap_ah",
    "fast_variables",
    "assessment_tier",
    "official_over_provider",
    "adjacent_reconcile",
    "fact_upsert",
    "point_validation",
    "latest_restatement",
    "event_change_log",
    "event_revisions",
    "zone_hysteresis",
    "best_document_per_year",
    "report_cash_flow",
    "report_dividends",
    "text_amounts",
)


def main() -> None:
    from cashlens.plans import catalog
    from cashlens.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the JVM before the clock
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
