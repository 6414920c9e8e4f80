"""Time the headline queries over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tickloom.plans import catalog
from tickloom.session import build_session

HEADLINE = [
    "ohlc_bars",
    "fill_gaps",
    "rollup_15m",
    "surge_scan_rma",
    "surge_ranked",
    "sector_heat",
    "percentile_ewma",
    "recent_overlay",
    "volume_consistency",
    "categories_exclusive",
    "ma_bundle",
    "rsi_signal",
    "final_signal",
    "scan_signals",
    "structure_breaks_swing",
    "order_blocks_internal",
    "open_gaps",
    "fuzzy_match",
    "search_instruments",
    "lookup_with_fallback",
    "order_tickets",
    "position_report",
    "explode_legs",
    "table_diff",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", cpus, spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executors' code paths once, outside the clock.
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    took, failed = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # told in the line; the others go on
            failed[name] = str(e).splitlines()[0][:200]
            continue
        took[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "failed": failed,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
