"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR  table folder  (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores   (default 8)
    BENCH_RUNS    timed runs a query, the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from rateline.plans.queries import QUERIES
from rateline.session import local_session

HEADLINE = (
    "evaluations_latest",
    "results_admin",
    "leaderboard",
    "leaderboard_by_division",
    "session_progress",
    "first_unscored",
    "skill_coverage",
    "pending_overlay",
    "session_cursor",
    "roster_positions",
    "roster_import",
    "integrity_report",
    "stream_progress",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=cpus)

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once("leaderboard")  # start-up and class loading are not part of any query
    times = {
        name: round(statistics.median(once(name) for _ in range(runs)), 3) for name in HEADLINE
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
