"""Routing of mixed event topics and the stateless reactions to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from agora import schemas
from agora.functions import text
from agora.operators import rules
from agora.sources import kafka
from agora.streaming.votes import in_time


def event_type(value: str = "value"):
    return F.get_json_object(F.col(value).cast("string"), "$.event_type")


def route(messages: DataFrame, kind: str) -> DataFrame:
    """Messages of one type as typed rows."""
    return kafka.parse(messages.where(event_type() == kind), schemas.EVENT_SCHEMAS[kind])


def unrouted(messages: DataFrame, known: tuple[str, ...] = tuple(schemas.EVENT_SCHEMAS)) -> DataFrame:
    """Messages of unknown or missing type, for the dead-letter table."""
    kind = event_type()
    return messages.withColumn("event_type", kind).where(kind.isNull() | ~kind.isin(*known))


def event_counters(messages: DataFrame) -> DataFrame:
    """Messages per topic and event type; unreadable ones count as errors."""
    kind = event_type()
    return messages.groupBy("topic", kind.alias("event_type")).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(kind.isNull()).alias("errors")
    )


def thought_insights(thoughts: DataFrame) -> DataFrame:
    """Words, characters, sentiment category and the first three tags per thought."""
    return thoughts.select(
        "user_id",
        "timestamp",
        text.word_count("thought_text").alias("word_count"),
        F.length("thought_text").alias("character_count"),
        text.sentiment_category("sentiment_score").alias("sentiment_category"),
        text.leading_tags("tags").alias("dominant_tags"),
    )


def with_category(thoughts: DataFrame) -> DataFrame:
    return thoughts.withColumn("sentiment_category", text.sentiment_category("sentiment_score"))


def with_sentiment(thoughts: DataFrame, analyse: Callable | None = None) -> DataFrame:
    """Fill missing sentiment scores from ``analyse`` (column to column, e.g. a pandas UDF).

    The default is the word-list score.
    """
    score = (analyse or text.lexicon_sentiment)(F.col("thought_text"))
    return thoughts.withColumn("sentiment_score", F.coalesce("sentiment_score", score))


def wellness_alerts(thoughts: DataFrame) -> DataFrame:
    return rules.low_sentiment(thoughts)


def metric_alerts(metrics: DataFrame) -> DataFrame:
    return rules.metric_alerts(metrics)


def thought_history(thoughts: DataFrame) -> DataFrame:
    """The record kept per user and thought; it grows in a table, not in state."""
    return thought_insights(thoughts).select("user_id", "timestamp", "sentiment_category", "dominant_tags", "word_count")


def algorithm_performance(recommendations: DataFrame) -> DataFrame:
    """Recommendations and mean confidence per algorithm. Batch, or a stream in update mode."""
    return recommendations.groupBy("algorithm").agg(
        F.count(F.lit(1)).alias("recommendations_generated"), F.avg("confidence_score").alias("average_confidence")
    )


def without_repeats(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop events whose id came before within the watermark delay."""
    return in_time(events, delay=delay).dropDuplicatesWithinWatermark(["event_id"])


def in_small_batches(writer: DataStreamWriter, seconds: int = 10) -> DataStreamWriter:
    """Flush at a fixed pace; the size of a flush is limited at the source (``maxOffsetsPerTrigger``)."""
    return writer.trigger(processingTime=f"{seconds} seconds")
