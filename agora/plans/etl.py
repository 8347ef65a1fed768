"""Extract, transform, validate and load the event datasets."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agora.functions import text, timeparts
from agora.operators import quality, skew
from agora.operators.quantiles import drop_outliers, drop_outliers_approx
from agora.sources import files

# Rolling frames (rows) and the width of the anomaly band.
SHORT_FRAME, LONG_FRAME = 5, 15
SIGMAS = 3


def standard_names(df: DataFrame) -> DataFrame:
    """Lower-case column names with underscores for blanks."""
    return df.toDF(*[name.lower().replace(" ", "_") for name in df.columns])


class MissingColumn(ValueError):
    """A dataset lacks a column that its transformation needs."""


def _require(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise MissingColumn(f"missing column: {', '.join(missing)}")


def transform_interactions(df: DataFrame, exact: bool = True) -> DataFrame:
    """Clean names and types, add time parts and session length, drop outliers.

    ``exact=False`` takes the quartiles from a sketch (one pass per column instead of two).
    """
    df = standard_names(df)
    _require(df, "timestamp")
    df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
    df = df.withColumns(
        {
            "hour": F.hour("timestamp"),
            "day_of_week": timeparts.weekday("timestamp"),
            "is_weekend": timeparts.is_weekend("timestamp"),
        }
    )
    if "interaction_type" in df.columns:
        df = df.withColumn("interaction_type", text.strip(F.lower("interaction_type")))
    if {"session_start", "session_end"} <= set(df.columns):
        df = df.withColumn(
            "session_duration",
            timeparts.seconds_between(F.to_timestamp("session_start"), F.to_timestamp("session_end")),
        )
    keep = drop_outliers if exact else drop_outliers_approx
    return keep(df, ["session_duration", "engagement_score"])


def transform_thoughts(df: DataFrame) -> DataFrame:
    """Clean text, count words, clip and name the sentiment, describe tags and time."""
    have = set(df.columns)
    if "thought_text" in have:
        df = df.withColumn("thought_text", text.clean_text("thought_text"))
        df = df.withColumn("word_count", text.word_count("thought_text"))
        df = df.withColumn("char_count", F.length("thought_text"))
    if "sentiment_score" in have:
        df = df.withColumn("sentiment_score", text.clip("sentiment_score"))
        df = df.withColumn("sentiment_category", text.sentiment_category("sentiment_score"))
    if "tags" in have:
        df = df.withColumn("tag_count", text.tag_count("tags"))
        df = df.withColumn("has_personal_tag", text.has_tag("tags"))
    if "timestamp" in have:
        df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
        df = df.withColumn("hour", F.hour("timestamp"))
        df = df.withColumn("day_of_week", timeparts.weekday("timestamp"))
    return df


def rolling_means(df: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Mean of the last 5 and 15 values per metric, null until the frame is full."""

    def columns(window) -> dict[str, Column]:
        new = {}
        for size in (SHORT_FRAME, LONG_FRAME):
            frame = window.rowsBetween(1 - size, 0)
            full = F.count("metric_value").over(frame) == size
            new[f"metric_value_ma_{size}"] = F.when(full, F.avg("metric_value").over(frame))
        return new

    return skew.over_history(
        df,
        keys=["metric_name"],
        time="timestamp",
        tie=list(tie),
        needs=["metric_value"],
        depth=LONG_FRAME - 1,
        columns=columns,
    )


def flag_anomalies(df: DataFrame, source: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Mark values more than three sample standard deviations from the mean of their metric.

    Mean and deviation come from an aggregation of ``source``, the rows ``df`` was made
    of, so no task sees a whole metric and nothing done to ``df`` is repeated.
    """
    spread = source.groupBy("metric_name").agg(
        F.avg("metric_value").alias("_mean"), F.stddev_samp("metric_value").alias("_stddev")
    )
    joined = df.join(spread, "metric_name", "left")
    far = F.abs(F.col("metric_value") - F.col("_mean")) > F.col("_stddev") * SIGMAS
    return joined.withColumn("is_anomaly", F.coalesce(far, F.lit(False))).drop("_mean", "_stddev")


def transform_metrics(df: DataFrame, tie: Sequence[str] = ("component",)) -> DataFrame:
    """Standard names, minute and hour, rolling means and anomaly flags.

    ``tie`` orders rows of one metric that share a timestamp.
    """
    _require(df, "metric_name", "metric_value", "timestamp", *tie)
    df = df.withColumn("metric_name", text.metric_name("metric_name"))
    df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
    df = df.withColumns(
        {"minute": F.date_trunc("minute", "timestamp"), "hour": F.date_trunc("hour", "timestamp")}
    )
    return flag_anomalies(rolling_means(df, tie), df, tie)


TRANSFORMS = {
    "interactions": transform_interactions,
    "thoughts": transform_thoughts,
    "metrics": transform_metrics,
}


@dataclass
class EtlResult:
    """What one run did; failures are listed by path, never swallowed."""

    records_processed: int = 0
    records_written: int = 0
    validation_failures: int = 0
    datasets_loaded: int = 0
    duration: float = 0.0
    reports: dict[str, dict] = field(default_factory=dict)
    written: dict[str, int] = field(default_factory=dict)
    not_read: dict[str, str] = field(default_factory=dict)
    not_transformed: dict[str, str] = field(default_factory=dict)
    not_loaded: dict[str, str] = field(default_factory=dict)

    @property
    def errors(self) -> dict[str, str]:
        return self.not_read | self.not_transformed | self.not_loaded

    @property
    def success(self) -> bool:
        return not self.errors


@dataclass(frozen=True)
class EtlConfig:
    """Switches of a run. ``quality_threshold`` is the least share of rows that must be valid."""

    enable_validation: bool = True
    enable_deduplication: bool = False
    deduplicate_on: tuple[str, ...] = ()
    quality_threshold: float | None = None


def run_etl(
    spark: SparkSession,
    paths: Sequence[str],
    target: str,
    as_of: datetime | str,
    config: EtlConfig = EtlConfig(),
) -> EtlResult:
    """Read, transform, validate and write all datasets.

    Datasets keep their path below the folder they share, so equal file names in different
    folders stay apart. A dataset that can't be read or transformed is listed and doesn't
    stop the others. A transformed dataset is kept on executor disks between the
    validation pass and the write; a lost executor only costs recomputing its blocks.
    """
    if config.enable_deduplication and not config.deduplicate_on:
        raise ValueError("deduplication needs the columns that identify a record")
    started = time.monotonic()
    result = EtlResult()
    datasets, result.not_read = files.read_batch(spark, paths)
    names = target_names(list(datasets))
    for path, raw in datasets.items():
        kept: DataFrame | None = None
        try:
            result.records_processed += raw.count()
            kind = files.dataset_kind(path)
            rows = TRANSFORMS[kind](raw)
            if config.enable_deduplication:
                rows = quality.deduplicate(rows, config.deduplicate_on)
            kept = rows.persist(StorageLevel.DISK_ONLY)
            report = quality.validate_dataset(kept, kind, as_of).first().asDict()
            result.reports[path] = report
            passed = report["passed"] and _good_enough(report, config.quality_threshold)
            if config.enable_validation and not passed:
                result.validation_failures += 1
                continue
            failed = files.write_batch({names[path]: kept}, target)
            if failed:
                result.not_loaded[path] = failed[names[path]]
            else:  # counted from the footers of the committed files
                result.written[path] = spark.read.parquet(files.batch_path(target, names[path])).count()
        except (PySparkException, MissingColumn) as error:
            result.not_transformed[path] = str(error).splitlines()[0]
        finally:
            if kept is not None:
                kept.unpersist()
    result.datasets_loaded = len(result.written)
    result.records_written = sum(result.written.values())
    result.duration = time.monotonic() - started
    return result


def target_names(paths: Sequence[str]) -> dict[str, str]:
    """Name of each dataset in the target: its path below the common folder, without suffix.

    Paths that differ in their suffix only keep it.
    """
    folders = [path.rstrip("/").split("/")[:-1] for path in paths]
    common = 0
    while folders and all(len(f) > common and f[common] == folders[0][common] for f in folders):
        common += 1
    below = {path: "/".join(path.rstrip("/").split("/")[common:]) for path in paths}
    bare = {path: name.rsplit(".", 1)[0] for path, name in below.items()}
    once = Counter(bare.values())
    return {path: bare[path] if once[bare[path]] == 1 else below[path].replace(".", "_") for path in paths}


def _good_enough(report: dict, threshold: float | None) -> bool:
    if threshold is None or not report["total_records"]:
        return True
    broken = [
        v for k, v in report.items()
        if isinstance(v, int) and not isinstance(v, bool) and k != "total_records"
    ]
    return 1 - max(broken, default=0) / report["total_records"] >= threshold


def run_row(spark: SparkSession, result: EtlResult, name: str, start: datetime, end: datetime) -> DataFrame:
    """The run record of an ETL run, one row."""
    errors = [f"{path}: {reason}" for path, reason in sorted(result.errors.items())]
    row = [(name, start, end, "completed" if result.success else "failed", result.records_processed,
            result.records_written, result.validation_failures, errors)]
    df = spark.createDataFrame(
        row,
        "job_name string, start_time timestamp, end_time timestamp, status string,"
        " input_records long, output_records long, error_records long, errors array<string>",
    )
    return df.withColumn("processing_time_seconds", timeparts.seconds_between("start_time", "end_time"))
