"""ETL, validation and typed-event queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from agora import schemas, session
from agora.functions import scores, text
from agora.operators import quality as jobs
from agora.plans import etl
from agora.sources import kafka
from agora.sources.adapter import AS_OF
from agora.streaming import events as reactions
from checks.registry import query

WS = r"[\s\x1c-\x1f\x85\p{Z}]"

FENCE = "BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
CLEAN_INTERACTIONS = f"""
    WITH a AS (SELECT *, (epoch_us(session_end) - epoch_us(session_start)) / 1e6::DOUBLE AS session_duration FROM interactions),
         q AS (SELECT quantile_cont(session_duration, 0.25) AS q1, quantile_cont(session_duration, 0.75) AS q3 FROM a),
         b AS (SELECT a.* FROM a, q WHERE session_duration {FENCE}),
         r AS (SELECT quantile_cont(engagement_score, 0.25) AS q1, quantile_cont(engagement_score, 0.75) AS q3 FROM b)
    SELECT b.*, hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week, isodow("timestamp") >= 6 AS is_weekend,
           trim(lower(interaction_type)) AS kind
    FROM b, r WHERE engagement_score {FENCE}"""


@query(
    "clean_interactions",
    "event_id:i user_id:s kind:s hour:i day_of_week:i is_weekend:b session_duration:f engagement_score:f",
    CLEAN_INTERACTIONS,
)
def _(t):
    return etl.transform_interactions(t.interactions).withColumn("kind", F.col("interaction_type"))


CLEAN_TEXT = rf"""regexp_replace(regexp_replace(regexp_replace(
    trim(regexp_replace(thought_text, '{WS}+', ' ', 'g'), ' '),
    'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+', '', 'g'),
    '\S+@\S+', '', 'g'), '[^a-zA-Z0-9\s.,!?;:]', '', 'g')"""


def _words(column: str) -> str:
    blank = f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'), ' ')"
    return f"CASE WHEN {blank} = '' THEN 0 ELSE len(string_split({blank}, ' ')) END"


SENTIMENT = """CASE WHEN sentiment_score > 0.3 THEN 'positive' WHEN sentiment_score < -0.3 THEN 'negative'
               WHEN sentiment_score IS NULL THEN {missing} ELSE 'neutral' END"""


@query(
    "clean_thoughts",
    "thought_id:i thought_text:s word_count:i char_count:i sentiment_score:f sentiment_category:s tag_count:i"
    " has_personal_tag:b hour:i day_of_week:i",
    f"""SELECT thought_id, clean AS thought_text, {_words('clean')} AS word_count, length(clean) AS char_count,
               CASE WHEN sentiment_score IS NOT NULL THEN greatest(least(sentiment_score, 1.0), -1.0) END AS sentiment_score,
               {SENTIMENT.format(missing="'neutral'")} AS sentiment_category,
               CASE WHEN thought_id % 10 = 0 THEN 0 ELSE 3 END AS tag_count,
               thought_id % 10 <> 0 AND thought_id % 3 = 0 AS has_personal_tag,
               hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week
        FROM (SELECT *, {CLEAN_TEXT} AS clean FROM thoughts)""",
)
def _(t):
    return etl.transform_thoughts(t.thoughts)


CLEAN_METRICS = """
    SELECT event_id, metric_name, metric_value, date_trunc('minute', "timestamp") AS minute, date_trunc('hour', "timestamp") AS hour,
           CASE WHEN count(*) OVER s = 5 THEN avg(metric_value) OVER s END AS metric_value_ma_5,
           CASE WHEN count(*) OVER l = 15 THEN avg(metric_value) OVER l END AS metric_value_ma_15,
           abs(metric_value - avg(metric_value) OVER (PARTITION BY metric_name))
           > 3 * stddev_samp(metric_value) OVER (PARTITION BY metric_name) AS is_anomaly
    FROM metrics
    WINDOW s AS (PARTITION BY metric_name ORDER BY "timestamp", event_id ROWS 4 PRECEDING),
           l AS (PARTITION BY metric_name ORDER BY "timestamp", event_id ROWS 14 PRECEDING)"""


@query(
    "clean_metrics",
    "event_id:i metric_name:s minute:t hour:t metric_value_ma_5:f metric_value_ma_15:f is_anomaly:b",
    CLEAN_METRICS,
)
def _(t):
    return etl.transform_metrics(t.metrics, tie=["event_id"])


@query(
    "validated_interactions",
    "total_records:i null_user_id:i null_timestamp:i null_interaction_type:i future_timestamps:i passed:b",
    """SELECT count(*) AS total_records, count(*) FILTER (WHERE user_id IS NULL) AS null_user_id,
              count(*) FILTER (WHERE "timestamp" IS NULL) AS null_timestamp,
              count(*) FILTER (WHERE interaction_type = 'share') AS null_interaction_type,
              count(*) FILTER (WHERE "timestamp" > TIMESTAMP '2024-01-25') AS future_timestamps, false AS passed
       FROM interactions""",
)
def _(t):
    gaps = t.interactions.withColumn(
        "interaction_type", F.when(F.col("interaction_type") != "share", F.col("interaction_type"))
    )
    return jobs.validate_dataset(gaps, "interactions", "2024-01-25 00:00:00")


@query(
    "validated_thoughts",
    "total_records:i empty_thoughts:i long_thoughts:i invalid_sentiment:i passed:b issues:l",
    """SELECT *, 'long_thoughts: ' || long_thoughts || '|invalid_sentiment: ' || invalid_sentiment AS issues FROM (
       SELECT count(*) AS total_records, count(*) FILTER (WHERE trim(thought_text) = '') AS empty_thoughts,
              count(*) FILTER (WHERE length(thought_text) > 10000) AS long_thoughts,
              count(*) FILTER (WHERE abs(sentiment_score) > 1) AS invalid_sentiment, true AS passed FROM thoughts)""",
)
def _(t):
    return jobs.validate_dataset(t.thoughts, "thoughts", AS_OF)


@query(
    "validated_metrics",
    "total_records:i negative_values:i extreme_values:i passed:b",
    """SELECT count(*) AS total_records, count(*) FILTER (WHERE metric_value < 10) AS negative_values,
              count(*) FILTER (WHERE (metric_value - 10) * 10000 > 1000000) AS extreme_values, true AS passed FROM metrics""",
)
def _(t):
    shifted = t.metrics.withColumn("metric_value", (F.col("metric_value") - 10) * 10000)
    return jobs.validate_dataset(shifted, "metrics", AS_OF)


def odd_interactions(t):
    """Interactions with some unknown devices, broken addresses and negative durations."""
    key = F.col("event_id")
    return t.interactions.withColumns(
        {
            "interaction_type": text.strip(F.lower("interaction_type")),
            "device_type": F.when(key % 50 == 0, "watch").otherwise("mobile"),
            "ip_address": F.when(key % 40 == 0, "10.0.300").otherwise("10.0.0.1"),
            "duration_ms": F.when(key % 30 == 0, F.lit(-5)).otherwise(F.lit(100)),
            "user_id": F.when(key % 70 == 0, "").otherwise(F.col("user_id")),
        }
    )


ODD = """SELECT event_id, 'device_type' AS field, 'choice' AS error_type, 'watch' AS value FROM interactions WHERE event_id % 50 = 0
         UNION ALL SELECT event_id, 'ip_address', 'format', '10.0.300' FROM interactions WHERE event_id % 40 = 0
         UNION ALL SELECT event_id, 'duration_ms', 'range', '-5' FROM interactions WHERE event_id % 30 = 0
         UNION ALL SELECT event_id, 'user_id', 'empty', '' FROM interactions WHERE event_id % 70 = 0"""


@query("interaction_errors", "event_id:i field:s error_type:s value:s", ODD)
def _(t):
    return jobs.valid_events(odd_interactions(t), "user_interaction")[1]


@query(
    "valid_interactions",
    "event_id:i interaction_type:s",
    """SELECT event_id, trim(lower(interaction_type)) AS interaction_type FROM interactions
       WHERE event_id % 50 <> 0 AND event_id % 40 <> 0 AND event_id % 30 <> 0 AND event_id % 70 <> 0""",
)
def _(t):
    return jobs.valid_events(odd_interactions(t), "user_interaction")[0]


@query(
    "user_errors",
    "user_id:s field:s error_type:s",
    """SELECT c_name AS user_id, 'user_id' AS field, 'format' AS error_type FROM customer
       UNION ALL SELECT c_name, 'email', 'format' FROM customer WHERE c_custkey % 3 = 0""",
)
def _(t):
    mail = F.when(F.col("c_custkey") % 3 == 0, "no mail").otherwise(F.concat(F.lower("c_mktsegment"), F.lit("@mail.org")))
    users = t.raw("customer").select(F.col("c_name").alias("user_id"), mail.alias("email"))
    return jobs.valid_events(users, "user")[1]


@query(
    "thought_errors",
    "thought_id:i field:s error_type:s",
    """SELECT thought_id, 'thought_text' AS field, 'length' AS error_type FROM thoughts WHERE length(thought_text) NOT BETWEEN 1 AND 10000
       UNION ALL SELECT thought_id, 'sentiment_score', 'range' FROM thoughts WHERE abs(sentiment_score) > 1""",
)
def _(t):
    return jobs.valid_events(t.thoughts, "thought_capture")[1]


@query(
    "typed_thoughts",
    "thought_id:i word_count:i character_count:i sentiment_category:s tags:l",
    rf"""SELECT thought_id, {_words('thought_text')} AS word_count,
                length(regexp_replace(thought_text, '^{WS}+|{WS}+$', '', 'g')) AS character_count,
                {SENTIMENT.format(missing="NULL")} AS sentiment_category,
                CASE WHEN thought_id % 10 = 0 THEN '' ELSE lang || '|' || source
                     || CASE WHEN thought_id % 3 = 0 THEN '|personal' ELSE '' END END AS tags
         FROM thoughts WHERE length(thought_text) BETWEEN 1 AND 10000 AND coalesce(abs(sentiment_score) <= 1, true)""",
)
def _(t):
    return jobs.typed_thoughts(t.thoughts)


@query(
    "content_errors",
    "content_id:s field:s error_type:s",
    """SELECT CAST(page_id AS VARCHAR) AS content_id, 'description' AS field, 'length' AS error_type
       FROM pages WHERE length(html) > 2000
       UNION ALL SELECT CAST(page_id AS VARCHAR), 'title', 'length'
       FROM pages WHERE length(regexp_extract(html, '<title>([^<]*)</title>', 1)) NOT BETWEEN 1 AND 500
       UNION ALL SELECT CAST(page_id AS VARCHAR), 'url', 'format' FROM pages WHERE NOT regexp_matches(url, '^https?://')""",
)
def _(t):
    return jobs.valid_events(t.content, "content")[1]


@query(
    "metric_errors",
    "event_id:i field:s error_type:s",
    """SELECT event_id, 'metric_name' AS field, 'format' AS error_type FROM metrics WHERE event_id % 17 = 0
       UNION ALL SELECT event_id, 'metric_value', 'number' FROM metrics WHERE event_id % 19 = 0""",
)
def _(t):
    odd = t.metrics.withColumns(
        {
            "metric_name": F.when(F.col("event_id") % 17 == 0, "two words").otherwise(F.col("metric_name")),
            "metric_value": F.when(F.col("event_id") % 19 == 0, float("nan")).otherwise(F.col("metric_value")),
        }
    )
    return jobs.valid_events(odd, "system_metric")[1]


@query(
    "recommendation_errors",
    "event_id:i field:s error_type:s",
    """SELECT event_id, 'recommended_content' AS field, 'size' AS error_type FROM recommendations WHERE content_count NOT BETWEEN 1 AND 50
       UNION ALL SELECT event_id, 'confidence_score', 'range' FROM recommendations WHERE confidence_score > 1
       UNION ALL SELECT event_id, 'feedback_score', 'range' FROM recommendations WHERE feedback_score > 5""",
)
def _(t):
    return jobs.valid_events(t.recommendations, "recommendation_generated")[1]


@query(
    "decision_errors",
    "id:i field:s error_type:s",
    """SELECT id, 'idea_id' AS field, 'range' AS error_type FROM decisions WHERE idea_id <= 0
       UNION ALL SELECT id, 'rationale', 'length' FROM decisions WHERE length(rationale) < 20
       UNION ALL SELECT id, 'timeline_days', 'range' FROM decisions WHERE timeline_days <= 0""",
)
def _(t):
    return jobs.split_valid(t.decisions, jobs.decision_rules())[1]


@query(
    "comment_errors",
    "comment_id:i error_type:s",
    "SELECT comment_id, 'length' AS error_type FROM comments WHERE length(content) NOT BETWEEN 1 AND 1000",
)
def _(t):
    return jobs.split_valid(t.comments, jobs.comment_rules())[1]


@query(
    "criteria_rule_counts",
    "field:s broken_rows:i",
    """SELECT 'name' AS field, count(*) FILTER (WHERE length(p_name) NOT BETWEEN 3 AND 100) AS broken_rows FROM part
       UNION ALL SELECT 'min_vote_count', count(*) FILTER (WHERE p_size - 2 < 0) FROM part
       UNION ALL SELECT 'min_average_rating', count(*) FILTER (WHERE p_size % 7 NOT BETWEEN 1 AND 5) FROM part
       UNION ALL SELECT 'max_controversy_score', count(*) FILTER (WHERE p_size % 12 > 10) FROM part
       UNION ALL SELECT 'min_days_since_created', 0 FROM (SELECT count(*) FROM part)
       UNION ALL SELECT 'max_days_in_review', count(*) FILTER (WHERE p_size % 5 < 1) FROM part
       UNION ALL SELECT 'min_success_probability', count(*) FILTER (WHERE p_size % 15 > 10) FROM part
       UNION ALL SELECT 'required_cluster_size', count(*) FILTER (WHERE p_size % 3 < 1) FROM part""",
)
def _(t):
    size = F.col("p_size")
    proposed = t.raw("part").select(
        F.col("p_name").alias("name"),
        (size - 2).alias("min_vote_count"),
        (size % 7).cast("double").alias("min_average_rating"),
        (size % 12 / 10).alias("max_controversy_score"),
        size.alias("min_days_since_created"),
        (size % 5).alias("max_days_in_review"),
        (size % 15 / 10).alias("min_success_probability"),
        (size % 3).alias("required_cluster_size"),
    )
    return jobs.rule_counts(proposed, jobs.criteria_rules())


QUALITY = """
    SELECT *, round(completeness_score * 0.4 + accuracy_score * 0.4 + consistency_score * 0.2, 3) AS overall_quality_score,
           CASE WHEN accuracy_score < 0.85 THEN 'fail_data_quality' WHEN completeness_score < 0.8 THEN 'fail_with_warnings'
                WHEN completeness_score < 0.9 THEN 'succeed_with_warnings' ELSE 'succeed' END AS result
    FROM (SELECT 'thoughts' AS dataset_name, count(*) AS total_records,
                 count(*) FILTER (WHERE ok) AS valid_records, count(*) FILTER (WHERE NOT ok) AS invalid_records,
                 (2 * count(*) + count(sentiment_score)) / (3.0 * count(*)) AS completeness_score,
                 count(*) FILTER (WHERE ok) / count(*)::DOUBLE AS accuracy_score,
                 count(*) FILTER (WHERE sentiment_score <= 0.5) / count(*)::DOUBLE AS consistency_score
          FROM (SELECT *, length(thought_text) <= 10000 AND coalesce(abs(sentiment_score) <= 1, true) AS ok FROM thoughts))"""


@query(
    "quality_report",
    "dataset_name:s total_records:i valid_records:i invalid_records:i completeness_score:f accuracy_score:f"
    " consistency_score:f overall_quality_score:f result:s",
    QUALITY,
)
def _(t):
    report = jobs.quality_report(
        t.thoughts,
        jobs.thought_rules(),
        "thoughts",
        ["user_id", "thought_text", "sentiment_score"],
        consistent=F.col("sentiment_score") <= 0.5,
    )
    return jobs.quality_gate(report)


@query(
    "event_batches",
    "batch_id:s total_events:i is_valid:b",
    """SELECT event_type || ' ' || strftime(occurred_at, '%Y') AS batch_id, count(*) AS total_events, count(*) <= 1000 AS is_valid
       FROM decision_events GROUP BY ALL""",
)
def _(t):
    batch = F.concat_ws(" ", "event_type", F.date_format("occurred_at", "yyyy"))
    return jobs.event_batches(t.decision_events, batch, limit=1000)


@query(
    "newest_interaction_per_user",
    "user_id:s interaction_type:s event_id:i",
    """SELECT * FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id, interaction_type ORDER BY "timestamp" DESC) = 1""",
)
def _(t):
    return jobs.deduplicate(t.interactions, ["user_id", "interaction_type"], newest="timestamp")


@query(
    "distinct_user_types",
    "user_id:s interaction_type:s",
    "SELECT DISTINCT user_id, interaction_type FROM interactions",
)
def _(t):
    return jobs.deduplicate(t.interactions.select("user_id", "interaction_type"), ["user_id", "interaction_type"])


@query(
    "thought_event_records",
    "event_type:s user_id:s word_count:i sentiment_score:f tag_count:i",
    f"""SELECT 'thought_capture' AS event_type, user_id, {_words('thought_text')} AS word_count, sentiment_score,
               CASE WHEN thought_id % 10 = 0 THEN 0 ELSE 3 END AS tag_count FROM thoughts""",
)
def _(t):
    return kafka.thought_events(t.thoughts).withColumn("tag_count", F.size("tags"))


@query(
    "recommendation_event_records",
    "event_type:s user_id:s algorithm:s content_count:i confidence_score:f",
    "SELECT *, 'recommendation_generated' AS event_type FROM recommendations",
)
def _(t):
    return kafka.recommendation_events(t.recommendations)


@query(
    "interaction_event_records",
    "event_type:s user_id:s interaction_type:s content_id:s",
    "SELECT *, 'user_interaction' AS event_type FROM interactions",
)
def _(t):
    return kafka.interaction_events(t.interactions)


@query(
    "metric_event_records",
    "event_type:s metric_name:s metric_value:f component:s",
    "SELECT *, 'system_metric' AS event_type FROM system_metrics",
)
def _(t):
    return kafka.metric_events(t.system_metrics)


@query(
    "vote_json_round_trip",
    "event_id:s event_type:s idea_id:i user_id:s vote_type:s rating:f timestamp:t ip_address:s",
    "SELECT * FROM vote_events",
)
def _(t):
    return kafka.parse(kafka.to_messages(t.vote_events, key="user_id"), schemas.VOTE_EVENT)


def messages_of(t):
    """The event topics as raw messages: thoughts, metrics and something unknown."""
    def topic(name, events):
        return kafka.to_messages(events).withColumn("topic", F.lit(name))

    strange = t.votes.select(F.lit("vote_cast").alias("event_type"), "vote_id")
    return (
        topic("thought-captures", kafka.thought_events(t.thoughts))
        .unionByName(topic("system-metrics", kafka.metric_events(t.system_metrics)))
        .unionByName(topic("user-interactions", strange))
    )


@query(
    "event_counters",
    "topic:s event_type:s processed:i errors:i",
    """SELECT 'thought-captures' AS topic, 'thought_capture' AS event_type, count(*) AS processed, 0 AS errors FROM thoughts
       UNION ALL SELECT 'system-metrics', 'system_metric', count(*), 0 FROM system_metrics
       UNION ALL SELECT 'user-interactions', 'vote_cast', count(*), 0 FROM votes""",
)
def _(t):
    return reactions.event_counters(messages_of(t))


@query(
    "routed_metrics",
    "metric_name:s metric_value:f component:s",
    "SELECT * FROM system_metrics",
)
def _(t):
    return reactions.route(messages_of(t), "system_metric")


@query(
    "unrouted_messages",
    "topic:s event_type:s message_count:i",
    "SELECT 'user-interactions' AS topic, 'vote_cast' AS event_type, count(*) AS message_count FROM votes",
)
def _(t):
    return (
        reactions.unrouted(messages_of(t))
        .groupBy("topic", "event_type")
        .agg(F.count(F.lit(1)).alias("message_count"))
    )


@query(
    "thought_insights",
    "user_id:s timestamp:t word_count:i character_count:i sentiment_category:s dominant_tags:l",
    f"""SELECT user_id, "timestamp", {_words('thought_text')} AS word_count, length(thought_text) AS character_count,
               {SENTIMENT.format(missing="'neutral'")} AS sentiment_category,
               CASE WHEN thought_id % 10 = 0 THEN '' ELSE ' ' || upper(lang) || '|' || source || '|'
                    || CASE WHEN thought_id % 3 = 0 THEN 'personal' ELSE 'not valid!' END END AS dominant_tags
        FROM thoughts""",
)
def _(t):
    return reactions.thought_insights(t.thoughts)


@query(
    "algorithm_performance",
    "algorithm:s recommendations_generated:i average_confidence:f",
    """SELECT algorithm, count(*) AS recommendations_generated, avg(confidence_score) AS average_confidence
       FROM recommendations GROUP BY algorithm""",
)
def _(t):
    return reactions.algorithm_performance(t.recommendations)


@query(
    "filled_sentiment",
    "thought_id:i sentiment_score:f",
    """SELECT thought_id, coalesce(sentiment_score, (length(thought_text) % 3 - 1)::DOUBLE) AS sentiment_score FROM thoughts""",
)
def _(t):
    return reactions.with_sentiment(t.thoughts, lambda c: (F.length(c) % 3 - 1).cast("double"))


@query(
    "import_scores",
    "idea_id:i engagement:f",
    "SELECT idea_id, vote_count / 100.0 AS engagement FROM rated_ideas",
)
def _(t):
    as_text = t.rated_ideas.select("idea_id", F.col("vote_count").cast("string").alias("vote_count"))
    return as_text.select("idea_id", scores.volume_score("vote_count", 100.0).alias("engagement"))


def _run_two_halves(t):
    """An ETL run over two datasets of one file name and one that lacks its timestamp."""
    folder = session.scratch_path(t.spark, "etl-run")
    half = F.dayofmonth("timestamp") <= 15
    t.thoughts.where(half).write.parquet(f"{folder}/in/first/thoughts.parquet")
    t.thoughts.where(~half).write.parquet(f"{folder}/in/second/thoughts.parquet")
    t.interactions.drop("timestamp").write.parquet(f"{folder}/in/broken_interactions.parquet")
    paths = [f"{folder}/in/{name}.parquet" for name in ("first/thoughts", "second/thoughts", "broken_interactions")]
    result = etl.run_etl(t.spark, paths, f"{folder}/out", AS_OF, etl.EtlConfig(enable_validation=False))
    return result, f"{folder}/out"


@query(
    "etl_loaded_rows",
    "dataset:s row_count:i id_sum:i words:i",
    f"""SELECT CASE WHEN day("timestamp") <= 15 THEN 'first/thoughts' ELSE 'second/thoughts' END AS dataset,
              count(*) AS row_count, sum(thought_id) AS id_sum, sum({_words("clean")}) AS words
       FROM (SELECT *, {CLEAN_TEXT} AS clean FROM thoughts) GROUP BY 1""",
)
def _(t):
    result, target = _run_two_halves(t)
    parts = [
        t.spark.read.parquet(f"{target}/{name}.parquet").select(F.lit(name).alias("dataset"), "thought_id", "word_count")
        for name in ("first/thoughts", "second/thoughts")
    ]
    return parts[0].unionByName(parts[1]).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("thought_id").alias("id_sum"), F.sum("word_count").alias("words")
    )


@query(
    "etl_run_report",
    "status:s input_records:i output_records:i error_records:i failed_datasets:i",
    """SELECT 'failed' AS status, (SELECT count(*) FROM thoughts) + (SELECT count(*) FROM interactions) AS input_records,
              (SELECT count(*) FROM thoughts) AS output_records, 0 AS error_records, 1 AS failed_datasets""",
)
def _(t):
    result, _ = _run_two_halves(t)
    moment = datetime(2024, 1, 1)
    return etl.run_row(t.spark, result, "etl", moment, moment).withColumn("failed_datasets", F.size("errors"))
