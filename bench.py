"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per query),
BENCH_QUERIES (``headline``, ``all`` or a comma-separated list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from strata.queries import load_all
from strata.session import build

HEADLINE = [
    "user_360", "user_360_travellers", "booking_metrics", "tourism_pivot", "recommendation_features",
    "daily_summary", "daily_event_summary", "regional_stats", "tour_performance", "cohort_retention",
    "clean_app_events", "envelope_decode", "contract_errors", "dedup_within_hour", "apply_changes",
    "table_checks", "dimension_scores", "source_status", "sessions", "journey_edges",
    "topic_rate", "mean_latency", "down_alerts", "recommendations", "content_scores", "document_search",
]


def run(df) -> None:
    """Computes every row and column and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "headline")
    spark = build(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_all()
    names = {"headline": HEADLINE, "all": list(registered)}.get(wanted) or wanted.split(",")
    seconds: dict[str, float] = {}
    for name in names:
        query = registered[name].run
        run(query(spark, sf_dir))  # warm-up
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run(query(spark, sf_dir))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds" if wanted == "headline" else "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
