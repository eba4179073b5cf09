"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data
and the number of local threads. Every query is run to the end into a no-op sink; the
first, untimed run warms up the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from finsieve.plans.catalog import QUERIES
from finsieve.session import local_session

HEADLINE = (
    "history_features", "what_if_features", "travel_alerts", "keyword_alerts", "ring_alerts",
    "largest_rings", "network_features", "customer_risk", "full_screening", "case_aggregates",
    "alert_stats", "judged_updates", "chronological_split", "ranking_metrics", "feature_drift",
    "point_in_time_features", "hash_assignment", "latency_percentiles", "labelled_dataset",
    "baseline_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    QUERIES["alert_stats"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spent = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
