"""Live vote aggregation, trending ideas and manipulation alerts."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from agora.operators import votes as vote_jobs
from agora.sources.kafka import Broker
from agora.sources.tables import TableStore
from agora.streaming import sinks

# Fixed value: how late a vote may arrive.
WATERMARK = "10 minutes"


def in_time(events: DataFrame, time: str = "timestamp", delay: str = WATERMARK) -> DataFrame:
    """Event time with a watermark; watermarks need TIMESTAMP, not TIMESTAMP_NTZ."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def aggregate_votes(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    return vote_jobs.votes_per_window(in_time(events), window)


def trending(windows: DataFrame, as_of: datetime | str | Column | None = None) -> DataFrame:
    """Positive trending scores; without ``as_of`` the clock of the micro-batch counts."""
    return vote_jobs.with_trending_score(windows, F.current_timestamp() if as_of is None else as_of)


def by_score(batch: DataFrame) -> DataFrame:
    """Order of a written batch; streams cannot sort outside complete mode."""
    return batch.orderBy(F.desc("trending_score"), "idea_id", "window_start")


def anomalies(events: DataFrame, window: str = "1 minute", max_votes: int = 20, max_ips: int = 5) -> DataFrame:
    return vote_jobs.voting_anomalies(in_time(events), window, max_votes, max_ips, streaming=True)


def rule_anomalies(events: DataFrame, rules: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Windows in which the count of a rule's events per subject reaches its limit.

    ``events`` has event, idea_id, user_id and timestamp; ``rules`` is a table of
    anomaly_type, severity, event, subject_column (idea_id or user_id), window_seconds and
    threshold, changed without touching the code. Each event meets the rules of its kind by
    a join with that table; the windows of each length in it have their own state, and all
    are one query. Works on a table and, in append or update mode, on a stream.
    """
    lengths = [row[0] for row in rules.select("window_seconds").distinct().orderBy("window_seconds").collect()]
    if not lengths:
        raise ValueError("at least one rule is needed")
    slim = events.select("event", "idea_id", "user_id", "timestamp")
    subject = F.when(F.col("subject_column") == "idea_id", F.col("idea_id").cast("string")).otherwise(F.col("user_id"))
    parts = []
    for seconds in lengths:
        # A watermark of its own for each length: state under a shared one is never let go.
        counted = (
            in_time(slim, delay=delay)
            .join(rules.where(F.col("window_seconds") == seconds), "event")
            .groupBy(
                F.window("timestamp", f"{seconds} seconds"),
                "anomaly_type",
                "severity",
                "threshold",
                subject.alias("subject"),
            )
            .agg(F.count(F.lit(1)).alias("event_count"))
        )
        parts.append(counted.where(F.col("event_count") >= F.col("threshold")))
    return reduce(DataFrame.unionByName, parts).select(
        "anomaly_type",
        "severity",
        "subject",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "event_count",
    )


def start_vote_processing(
    events: DataFrame, broker: Broker, store: TableStore, checkpoints: str
) -> dict[str, StreamingQuery]:
    """Start the three live queries: aggregates and anomalies to topics, trending to a table.

    Each has a checkpoint of its own, so each resumes where it stopped.
    """
    windows = aggregate_votes(events)
    writers = {
        "aggregates": broker.writer(windows, "vote-aggregates", f"{checkpoints}/vote-aggregates"),
        "trending": sinks.to_table(
            trending(windows), store, "trending_ideas", f"{checkpoints}/trending-ideas", shape=by_score
        ),
        "anomalies": broker.writer(anomalies(events), "vote-anomalies", f"{checkpoints}/vote-anomalies"),
    }
    return {name: writer.queryName(name).start() for name, writer in writers.items()}


def start_vote_files(events: DataFrame, folder: str, checkpoints: str) -> dict[str, StreamingQuery]:
    """The same three queries with files as sinks, run until the source is read."""
    windows = aggregate_votes(events)
    writers = {
        "aggregates": sinks.to_files(windows, f"{folder}/vote_aggregates", f"{checkpoints}/vote-aggregates", "update"),
        "trending": sinks.to_files(
            trending(windows), f"{folder}/trending_ideas", f"{checkpoints}/trending-ideas", "update", by_score
        ),
        "anomalies": sinks.to_files(
            anomalies(events), f"{folder}/vote_anomalies", f"{checkpoints}/vote-anomalies", "update"
        ),
    }
    return {n: w.queryName(n).trigger(availableNow=True).start() for n, w in writers.items()}


def stop_all(spark: SparkSession) -> list[str]:
    """Stop every active query; names of those stopped."""
    stopped = []
    for query in spark.streams.active:
        query.stop()
        stopped.append(query.name or str(query.id))
    return stopped


def await_all(queries: dict[str, StreamingQuery], timeout: float | None = None) -> None:
    """Wait for all queries; stop the rest and pass the error on if one fails."""
    try:
        for query in queries.values():
            query.awaitTermination(timeout) if timeout is not None else query.awaitTermination()
    except BaseException:
        for query in queries.values():
            query.stop()
        raise
