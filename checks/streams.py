"""Streaming queries, run over the given files until they are read, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from agora import session
from agora.operators import users as user_jobs
from agora.sources.adapter import AS_OF, GivenTables
from agora.streaming import events as reactions
from agora.streaming import sinks, stateful
from agora.streaming import votes as live
from checks.registry import query
from checks.votes import ACTIVITY, ACTIVITY_COLUMNS, RULES, WINDOW_COLUMNS, WINDOWS


#: The rules of the batch query as a table.
RULE_SCHEMA = "anomaly_type string, severity string, event string, subject_column string, window_seconds long, threshold long"
RULE_ROWS = [
    (kind, rule["severity"], rule["event"], rule["key"], {"1 day": 86_400, "1 hour": 3_600}[rule["window"]], rule["limit"])
    for kind, rule in RULES.items()
]


class StreamTables(GivenTables):
    """The same domain tables on a stream of the events file."""

    def raw(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        # A folder or a glob is what the file source wants.
        return self.spark.readStream.schema(schema).parquet(path.replace(".parquet", "*.parquet"))


def stream(t: GivenTables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


def result_of(t: GivenTables, rows: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream to the end and read what it wrote, with the batch of each row."""
    out = session.scratch_path(t.spark, name)
    sinks.run_available(sinks.to_files(rows, f"{out}/rows", f"{out}/checkpoint", mode))
    return t.spark.read.parquet(f"{out}/rows")


def last_update(rows: DataFrame, *keys: str) -> DataFrame:
    """Update mode repeats changed keys; the latest batch counts."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


@query("streamed_votes_per_window", WINDOW_COLUMNS, WINDOWS)
def _(t):
    rows = result_of(t, live.aggregate_votes(stream(t).vote_events), "update", "votes-per-window")
    return last_update(rows, "window_start", "idea_id")


@query(
    "streamed_trending_ideas",
    "idea_id:i window_end:t trending_score:f",
    f"""SELECT * FROM (SELECT *, (upvotes * 2 + ratings * 1.5 - downvotes)
               * exp(-0.1 * date_diff('second', window_end, TIMESTAMP '{AS_OF}') / 3600.0) AS trending_score
        FROM ({WINDOWS})) WHERE trending_score > 0""",
)
def _(t):
    scored = live.trending(live.aggregate_votes(stream(t).vote_events), AS_OF)
    return last_update(result_of(t, scored, "update", "trending"), "window_start", "window_end", "idea_id")


@query(
    "streamed_anomalies",
    "window_start:t user_id:s vote_count:i unique_ideas:i unique_ips:i",
    """SELECT date_trunc('day', created_at)::TIMESTAMP AS window_start, user_id, count(*) AS vote_count,
              count(DISTINCT idea_id) AS unique_ideas, count(DISTINCT ip_address) AS unique_ips
       FROM votes GROUP BY ALL HAVING count(*) > 3 OR count(DISTINCT ip_address) > 5""",
)
def _(t):
    found = live.anomalies(stream(t).vote_events, window="1 day", max_votes=3)
    return last_update(result_of(t, found, "update", "anomalies"), "window_start", "user_id")


@query(
    "streamed_milestones",
    "user_id:s total_interactions:i",
    """SELECT user_id, unnest(range(1, n // 10 + 1)) * 10 AS total_interactions
       FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY 1)""",
)
def _(t):
    stateful.use_state_store(t.spark)
    return result_of(t, stateful.milestones(stream(t).interactions), "update", "milestones")


@query(
    "streamed_vote_limit",
    "user_id:s event_id:s window_position:i is_allowed:b",
    """WITH RECURSIVE ordered AS (
           SELECT user_id, event_id, "timestamp" AS t,
                  row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS k FROM vote_events
           WHERE epoch_us("timestamp") <= (SELECT epoch_us(max("timestamp")) // 1000 * 1000 FROM vote_events) -- the last one waits
       ), judged AS (
           SELECT user_id, event_id, k, t AS opened, 1 AS window_position FROM ordered WHERE k = 1
           UNION ALL
           SELECT o.user_id, o.event_id, o.k, CASE WHEN o.t >= j.opened + INTERVAL 6 HOUR THEN o.t ELSE j.opened END,
                  CASE WHEN o.t >= j.opened + INTERVAL 6 HOUR THEN 1 ELSE j.window_position + 1 END
           FROM judged j JOIN ordered o ON o.user_id = j.user_id AND o.k = j.k + 1
       )
       SELECT user_id, event_id, window_position, window_position <= 1 AS is_allowed FROM judged""",
)
def _(t):
    stateful.use_state_store(t.spark)
    judged = stateful.limit_votes(stream(t).vote_events, limit=1, seconds=6 * 3600, delay="0 seconds")
    return result_of(t, judged, "append", "vote-limit")


@query(
    "streamed_thought_history",
    "user_id:s place:i event_id:s sentiment_category:s word_count:i",
    """SELECT user_id, row_number() OVER newest AS place, CAST(thought_id AS VARCHAR) AS event_id,
              CASE WHEN sentiment_score > 0.3 THEN 'positive' WHEN sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END
              AS sentiment_category, thought_id % 97 AS word_count
       FROM thoughts
       WINDOW newest AS (PARTITION BY user_id ORDER BY "timestamp" DESC, CAST(thought_id AS VARCHAR) DESC) QUALIFY place <= 3""",
)
def _(t):
    stateful.use_state_store(t.spark)
    rows = reactions.with_category(stream(t).thoughts).withColumns(
        {"event_id": F.col("thought_id").cast("string"), "word_count": F.col("thought_id") % 97}
    )
    return last_update(result_of(t, stateful.recent_thoughts(rows, keep=3), "update", "history"), "user_id", "place")


@query("streamed_activity_anomalies", ACTIVITY_COLUMNS, ACTIVITY)
def _(t):
    rows = stream(t)
    votes = rows.votes.select(F.lit("vote").alias("event"), "idea_id", "user_id", F.col("created_at").alias("timestamp"))
    comments = rows.comments.select(F.lit("comment").alias("event"), "idea_id", "user_id", F.col("created_at").alias("timestamp"))
    rules = t.spark.createDataFrame(RULE_ROWS, RULE_SCHEMA)
    found = live.rule_anomalies(votes.unionByName(comments), rules)
    return last_update(result_of(t, found, "update", "activity"), "anomaly_type", "subject", "window_start")


@query(
    "streamed_vote_changes",
    "idea_id:i upvotes:i downvotes:i",
    """SELECT idea_id, count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes, count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes
       FROM (SELECT idea_id, CASE WHEN event_type <> 'vote_removed' THEN vote_type END AS vote_type FROM vote_events
             QUALIFY row_number() OVER (PARTITION BY idea_id, user_id ORDER BY "timestamp" DESC, event_id DESC) = 1)
       GROUP BY idea_id""",
)
def _(t):
    stateful.use_state_store(t.spark)
    changes = result_of(t, stateful.vote_changes(stream(t).vote_events), "append", "vote-changes")
    return changes.groupBy("idea_id").agg(
        F.sum("upvote_change").alias("upvotes"), F.sum("downvote_change").alias("downvotes")
    )


@query(
    "streamed_metric_alerts",
    "event_id:i metric_name:s metric_value:f threshold:f",
    """SELECT * FROM (SELECT *, CASE metric_name WHEN 'cpu_usage' THEN 80 WHEN 'memory_usage' THEN 85 WHEN 'response_time' THEN 2000
                                     WHEN 'error_rate' THEN 5 END AS threshold FROM system_metrics)
       WHERE metric_value > threshold""",
)
def _(t):
    return result_of(t, reactions.metric_alerts(stream(t).system_metrics), "append", "metric-alerts")


@query(
    "streamed_algorithm_performance",
    "algorithm:s recommendations_generated:i average_confidence:f",
    """SELECT algorithm, count(*) AS recommendations_generated, avg(confidence_score) AS average_confidence
       FROM recommendations GROUP BY algorithm""",
)
def _(t):
    rows = result_of(t, reactions.algorithm_performance(stream(t).recommendations), "update", "algorithms")
    return last_update(rows, "algorithm")


@query(
    "streamed_without_repeats",
    "event_id:s vote_type:s",
    "SELECT * FROM vote_events",
)
def _(t):
    twice = stream(t).vote_events.unionByName(stream(t).vote_events)
    return result_of(t, reactions.without_repeats(twice), "append", "distinct-events")


@query("streamed_sessions", "user_id:s start_time:t interactions:i duration_seconds:i")
def _(t):
    events = live.in_time(stream(t).interactions)
    return result_of(t, user_jobs.user_sessions(events, gap="12 hours"), "append", "sessions")


@query(
    "streamed_thought_insights",
    "user_id:s character_count:i sentiment_category:s",
    """SELECT user_id, length(thought_text) AS character_count,
              CASE WHEN sentiment_score > 0.3 THEN 'positive' WHEN sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END
              AS sentiment_category FROM thoughts""",
)
def _(t):
    return result_of(t, reactions.thought_insights(stream(t).thoughts), "append", "insights")
