"""Message-broker sources and sinks, and the typed events that travel through them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from agora import schemas
from agora.functions import text

# Durability options of the producer, topics and the event version.
PRODUCER_OPTIONS = {
    "kafka.acks": "all",
    "kafka.retries": "3",
    "kafka.batch.size": "16384",
    "kafka.linger.ms": "10",
    "kafka.compression.type": "snappy",
    "kafka.max.in.flight.requests.per.connection": "5",
    "kafka.enable.idempotence": "true",
}
VOTE_TOPIC = "vote-events"
EVENT_TOPICS = ("user-interactions", "thought-captures", "system-metrics", "recommendations")
EVENT_VERSION = "1.0"


@dataclass(frozen=True)
class Broker:
    servers: str
    group: str | None = None

    def read_options(self, *topics: str, offsets: str = "latest", max_per_trigger: int | None = None) -> dict[str, str]:
        options = {
            "kafka.bootstrap.servers": self.servers,
            "subscribe": ",".join(topics),
            "startingOffsets": offsets,
            "failOnDataLoss": "false",
        }
        if self.group is not None:
            options["kafka.group.id"] = self.group
        if max_per_trigger is not None:
            options["maxOffsetsPerTrigger"] = str(max_per_trigger)
        return options

    def write_options(self, topic: str | None = None) -> dict[str, str]:
        options = {"kafka.bootstrap.servers": self.servers, **PRODUCER_OPTIONS}
        if topic is not None:
            options["topic"] = topic
        return options

    def stream(self, spark: SparkSession, *topics: str, **kwargs) -> DataFrame:
        return spark.readStream.format("kafka").options(**self.read_options(*topics, **kwargs)).load()

    def vote_stream(self, spark: SparkSession) -> DataFrame:
        return parse_votes(self.stream(spark, VOTE_TOPIC))

    def event_stream(self, spark: SparkSession, max_per_trigger: int | None = None) -> DataFrame:
        """All event topics as one stream; offsets live in the checkpoint of the query."""
        return self.stream(spark, *EVENT_TOPICS, max_per_trigger=max_per_trigger)

    def send(self, messages: DataFrame, topic: str) -> int:
        """Publish a batch of (key, value[, partition]) rows; the number sent."""
        sent = Observation("sent")
        messages.observe(sent, F.count(F.lit(1)).alias("rows")).write.format("kafka").options(
            **self.write_options(topic)
        ).save()
        return int(sent.get["rows"])

    def writer(self, df: DataFrame, topic: str, checkpoint: str, mode: str = "update") -> DataStreamWriter:
        return (
            to_messages(df)
            .writeStream.format("kafka")
            .options(**self.write_options(topic))
            .option("checkpointLocation", checkpoint)
            .outputMode(mode)
        )


def to_messages(df: DataFrame, key: str | None = None, partition: str | None = None) -> DataFrame:
    """Rows as JSON values with an optional key and partition."""
    columns: list[Column] = []
    if key is not None:
        columns.append(F.col(key).cast("string").alias("key"))
    columns.append(serialise(df).alias("value"))
    if partition is not None:
        columns.append(F.col(partition).cast("int").alias("partition"))
    return df.select(*columns)


def serialise(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


def parse(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON values as typed rows; a value that is not valid lands in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return messages.select(F.from_json(F.col(value).cast("string"), full, options).alias("_data")).select("_data.*")


def _read_votes(messages: DataFrame) -> DataFrame:
    raw = messages.select(F.col("value").cast("string").alias("_raw"))
    full = T.StructType([*schemas.VOTE_EVENT.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return raw.withColumn("_data", F.from_json("_raw", full, options))


# A vote that names no idea, or can't be read at all, would be counted under a null idea.
_BROKEN = "_data IS NULL OR _data._corrupt IS NOT NULL OR _data.idea_id IS NULL"


def parse_votes(messages: DataFrame) -> DataFrame:
    """Readable votes; the others are :func:`dead_votes`."""
    votes = _read_votes(messages).where(f"NOT ({_BROKEN})").select("_data.*").drop("_corrupt")
    return votes.withColumn("processing_time", F.current_timestamp())


def dead_votes(messages: DataFrame) -> DataFrame:
    """Messages that hold no vote, as they came, for a dead-letter table."""
    return _read_votes(messages).where(_BROKEN).select(
        F.col("_raw").alias("value"), F.current_timestamp().alias("processing_time")
    )


def enrich(events: DataFrame, producer_id: str) -> DataFrame:
    """Add the envelope: id, UTC time of sending, producer and version."""
    return events.withColumns(
        {
            "event_id": F.uuid(),
            "timestamp": F.current_timestamp(),
            "producer_id": F.lit(producer_id),
            "version": F.lit(EVENT_VERSION),
        }
    )


def _or_empty_map(df: DataFrame, name: str) -> Column:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.col(name), empty) if name in df.columns else empty


def interaction_events(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("user_interaction").alias("event_type"),
        "user_id",
        "interaction_type",
        "content_id",
        _or_empty_map(df, "metadata").alias("metadata"),
    )


def thought_events(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("thought_capture").alias("event_type"),
        "user_id",
        "thought_text",
        "sentiment_score",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        text.word_count("thought_text").alias("word_count"),
    )


def metric_events(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("system_metric").alias("event_type"),
        "metric_name",
        "metric_value",
        "component",
        _or_empty_map(df, "metadata").alias("metadata"),
    )


def recommendation_events(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("recommendation_generated").alias("event_type"),
        "user_id",
        "recommended_content",
        "algorithm",
        "confidence_score",
        F.size("recommended_content").alias("content_count"),
    )


def keyed_messages(events: DataFrame, event_type: str, producer_id: str) -> tuple[str, DataFrame]:
    """Topic and enriched messages of a table of typed events."""
    topic, key = schemas.EVENT_TOPICS[event_type]
    return topic, to_messages(enrich(events, producer_id), key=key)
