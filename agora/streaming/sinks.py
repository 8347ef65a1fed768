"""Streaming sinks that stay correct when a batch is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from agora.sources.tables import TableStore


def to_files(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    mode: str = "append",
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> DataStreamWriter:
    """Each micro-batch overwrites its own folder, below one of its query: a repeated batch replaces itself.

    ``shape`` may do what streams refuse, e.g. sort. Errors end the query.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if shape is None else shape(batch)
        own = f"{folder.rstrip('/')}/query_id={query_id(batch, checkpoint)}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(own)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    )


def query_id(batch: DataFrame, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint: a new checkpoint is a new query."""
    return batch.sparkSession.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def to_table(
    stream: DataFrame,
    store: TableStore,
    table: str,
    checkpoint: str,
    mode: str = "update",
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> DataStreamWriter:
    """Write non-empty micro-batches to a table once; rows carry ``query_id`` and ``batch_id``.

    A repeated batch of the same query replaces what it wrote before, also the half of it.
    Batches of other queries, and of a query with a new checkpoint, are their own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows = batch if shape is None else shape(batch)
        store.write_batch(rows, table, query_id(batch, checkpoint), batch_id)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    )


def to_console(stream: DataFrame, mode: str = "update") -> DataStreamWriter:
    return stream.writeStream.format("console").outputMode(mode).option("truncate", False)


def run_available(writer: DataStreamWriter) -> None:
    """Process everything the source has now, then end."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
