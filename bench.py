"""Headline queries, timed end to end from the given tables.

Prints one JSON line. Each time is the median of three runs after one warm-up;
every run reads Parquet, computes all rows and columns, and discards them.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog
from tools.local_session import local_session

HEADLINE = [
    "demo_panel",
    "feature_set",
    "price_buckets",
    "all_rules",
    "leaderboard",
    "walk_forward_refit",
    "shrunk_fixed_prior",
    "column_coverage",
    "season_profile",
    "audit_report",
    "audit_by_name",
    "folded_names",
    "forecast_next_period",
    "feature_set_by_chunks",
    "average_rank_by_histogram",
    "output_rank_by_buckets",
    "rank_correlation_by_histogram",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def timed(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(os.environ.get("BENCH_CPUS", "8"))
        seconds = {}
        for name in wanted:
            timed(spark, sf_dir, name)
            seconds[name] = round(
                statistics.median(timed(spark, sf_dir, name) for _ in range(RUNS)), 3
            )
            print(name, seconds[name], file=sys.stderr, flush=True)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "panel analytics, sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
