"""Benchmark: median seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query is run once to warm up; then the median of the timed runs counts. Results are
written to the ``noop`` sink, so every column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "vote_totals_large",
    "vote_metrics_large",
    "votes_per_window",
    "voting_anomalies",
    "trending_ideas",
    "latest_votes",
    "vote_history",
    "idea_metrics",
    "category_insights",
    "user_analytics",
    "top_performers",
    "interaction_edges",
    "interaction_milestones",
    "organization_analytics",
    "replayed_decisions",
    "status_moves",
    "actor_recent_actions",
    "committee_results",
    "decision_suggestions",
    "clean_interactions",
    "clean_thoughts",
    "clean_metrics",
    "typed_thoughts",
    "quality_report",
    "vote_json_round_trip",
]
# Run once each, without a warm-up: a stream and model training.
ONCE = ["streamed_votes_per_window", "success_predictions", "topic_clusters"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:]

    from agora.session import local_session
    from checks import QUERIES

    spark = local_session(cpus, "agora-bench")

    def seconds(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    timings: dict[str, float] = {}
    for name in HEADLINE + ONCE:
        if wanted and name not in wanted:
            continue
        if name in HEADLINE:
            seconds(name)
            timings[name] = round(statistics.median(seconds(name) for _ in range(runs)), 3)
        else:
            timings[name] = round(seconds(name), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)

    events = spark.read.parquet(f"{folder}/events.parquet")
    votes = events.where("event_type IN ('click', 'error', 'purchase')").count()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    rates = {}
    for name, rows in (("vote_totals_large", lines), ("votes_per_window", votes), ("streamed_votes_per_window", votes)):
        if timings.get(name):
            rates[name] = round(rows / timings[name])
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "votes_per_second": rates,
                "cpus": cpus,
                "spark": spark.version,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
