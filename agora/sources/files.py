"""File datasets of the ETL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from agora import schemas

# What in a path tells the kind of dataset.
KINDS = ("interactions", "thoughts", "metrics")


def dataset_kind(path: str) -> str | None:
    return next((kind for kind in KINDS if kind in path), None)


def _read(
    spark: SparkSession, path: str, schema: T.StructType | None, known: T.StructType | None = None
) -> DataFrame:
    """Read by suffix. Without a schema the columns are those of the file.

    A schema adds the columns a file lacks, filled with nulls; later steps treat a
    missing column differently from an empty one, so it is not imposed by default. CSV
    columns take their types from ``known`` where it names them.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".parquet"):
        return reader.parquet(path)
    if path.endswith(".csv"):
        if schema is None:
            types = {} if known is None else {f.name: f.dataType for f in known.fields}
            header = spark.read.option("header", True).csv(path).columns
            reader = spark.read.schema(
                T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
            )
        return reader.option("header", True).csv(path)
    if path.endswith((".json", ".jsonl")):
        return reader.json(path)
    raise ValueError(f"unsupported file format: {path}")


def read_interactions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, CSV with a header, or JSON lines, by suffix.

    Give ``schemas.INTERACTIONS`` for large JSON inputs: inferring reads them once more.
    """
    return _read(spark, path, schema, schemas.INTERACTIONS)


def read_thoughts(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; the fields of ``metadata`` become columns, prefixed where a name is taken."""
    return flatten(_read(spark, path, schema, schemas.THOUGHTS), "metadata")


def flatten(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.StructType):
        return df
    outer = [c for c in df.columns if c != column]
    inner = [
        F.col(f"{column}.{name}").alias(name if name not in outer else f"{column}_{name}")
        for name in df.schema[column].dataType.names
    ]
    return df.select(*outer, *inner)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet; text or zone-less timestamps become timestamps."""
    df = _read(spark, path, schema)
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
    return df


READERS = {"interactions": read_interactions, "thoughts": read_thoughts, "metrics": read_metrics}


def read_batch(spark: SparkSession, paths: Sequence[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Lazy datasets by path, and the paths that could not be used with the reason."""
    datasets: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for path in paths:
        kind = dataset_kind(path)
        if kind is None:
            failed[path] = "unknown kind of dataset"
            continue
        try:
            datasets[path] = READERS[kind](spark, path)
        except (AnalysisException, ValueError) as error:
            failed[path] = str(error).splitlines()[0]
    return datasets, failed


def read_ideas_csv(spark: SparkSession, path: str, tag_separator: str = ";") -> DataFrame:
    """Bulk import of ideas with their original timestamps; unreadable values become null."""
    plain = T.StructType([f for f in schemas.IDEAS.fields if not isinstance(f.dataType, T.ArrayType)])
    ideas = _read(spark, path, None, plain)
    if "tags" in ideas.columns:
        ideas = ideas.withColumn("tags", F.split("tags", tag_separator))
    return ideas


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] | None = None,
    mode: str = "overwrite",
    files: int | None = None,
) -> None:
    """Snappy parquet, optionally partitioned by columns or coalesced to few files."""
    if files is not None:
        df = df.coalesce(files)
    writer = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def batch_path(base: str, name: str) -> str:
    """Where :func:`write_batch` puts a dataset."""
    return f"{base}/{name}.parquet"


def write_batch(datasets: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Write every dataset below ``base``; those with timestamps are stored by date.

    Rows are gathered by date before the write, so a date gets few files, and a heavy
    date is still split by the adaptive rebalancing. Returns what failed, by name.
    """
    failed: dict[str, str] = {}
    for name, df in datasets.items():
        target = batch_path(base, name)
        try:
            if "timestamp" in df.columns:
                dated = df.withColumn("date", F.to_date("timestamp"))
                write_parquet(dated.hint("rebalance", "date"), target, ["date"])
            else:
                write_parquet(df, target)
        except Exception as error:  # noqa: BLE001 - reported to the caller
            failed[name] = str(error).splitlines()[0]
    return failed


def with_partitions(df: DataFrame, shuffle_to: int, files: int) -> DataFrame:
    """Redistribute rows, then merge partitions without another shuffle, before a write."""
    return df.repartition(shuffle_to).coalesce(files)
