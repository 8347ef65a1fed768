"""Tables in a database or in files, behind one interface."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

# Driver class and batch sizes of the database connection, and how the
# database says that a table is missing.
JDBC_DRIVER = "org.postgresql.Driver"
NO_SUCH_TABLE = "42P01"
FETCH_SIZE, BATCH_SIZE = 1000, 1000


@dataclass(frozen=True)
class KeyRange:
    """A numeric or date column that cuts a JDBC scan into parallel parts."""

    column: str
    lower: str
    upper: str
    parts: int


@dataclass(frozen=True)
class JdbcTables:
    """Database tables. User and password come from the environment, never from code."""

    url: str
    ranges: dict[str, KeyRange] = field(default_factory=dict)
    writers: int = 16

    def properties(self) -> dict[str, str]:
        return {
            "driver": JDBC_DRIVER,
            "user": os.environ.get("DB_USER", ""),
            "password": os.environ.get("DB_PASSWORD", ""),
        }

    def read_options(self, table: str) -> dict[str, str]:
        options = {**self.properties(), "url": self.url, "dbtable": table, "fetchsize": str(FETCH_SIZE)}
        cut = self.ranges.get(table)
        if cut is not None:
            options |= {
                "partitionColumn": cut.column,
                "lowerBound": cut.lower,
                "upperBound": cut.upper,
                "numPartitions": str(cut.parts),
            }
        return options

    def write_options(self, table: str) -> dict[str, str]:
        return {
            **self.properties(), "url": self.url, "dbtable": table, "batchsize": str(BATCH_SIZE), "numPartitions": str(self.writers)
        }

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.read_options(table)).load()

    def write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        df.write.format("jdbc").options(**self.write_options(table)).mode(mode).save()

    def write_batch(self, df: DataFrame, table: str, query: str, batch: int) -> None:
        """Write a micro-batch on many connections; it counts from its commit on.

        The rows of a try carry its number, and a single row in a table of commits makes the
        try the batch. A try that fails half-way has no commit, so its rows don't count; a batch
        that is committed is not written again. If two writers of one batch both commit, the
        smaller number counts. Read with :meth:`read_committed`.
        """
        spark = df.sparkSession
        commits = commits_of(table)
        if self.exists(spark, commits) and not _of_batch(self.read(spark, commits), query, batch).isEmpty():
            return
        attempt = uuid.uuid4().hex
        self.write(_marked(df, query, batch).withColumn("attempt", F.lit(attempt)), table)
        self.write(_marked(spark.range(1), query, batch).select("query_id", "batch_id", F.lit(attempt).alias("attempt")), commits)

    def read_committed(self, spark: SparkSession, table: str) -> DataFrame:
        """The rows of all committed batches of a table that :meth:`write_batch` fills."""
        return self.read(spark, table).join(self._counting(spark, table), ["query_id", "batch_id", "attempt"], "left_semi")

    def abandoned(self, spark: SparkSession, table: str) -> DataFrame:
        """(query_id, batch_id, attempt) of tries without a commit that counts, for deletion."""
        tries = self.read(spark, table).select("query_id", "batch_id", "attempt").distinct()
        if not self.exists(spark, commits_of(table)):
            return tries
        return tries.join(self._counting(spark, table), ["query_id", "batch_id", "attempt"], "left_anti")

    def _counting(self, spark: SparkSession, table: str) -> DataFrame:
        commits = self.read(spark, commits_of(table))
        return commits.groupBy("query_id", "batch_id").agg(F.min("attempt").alias("attempt"))

    def read_sliced(self, spark: SparkSession, table: str, column: str, parts: int, split_by: str | None = None) -> DataFrame:
        """A table in about equal parts, cut at quantiles that the database computes.

        No bounds are set by hand and no part depends on how the values of the column are spread.
        A value that fills more than one part is a part alone, cut by ``split_by``, a column of
        whole numbers, if that is given. Missing values have a part of their own.
        """
        query = borders_query(table, column, parts)
        borders = spark.read.format("jdbc").options(**self.properties(), url=self.url, dbtable=query).load()
        values = [row[0] for row in borders.collect()]  # at most ``parts``
        predicates = slice_predicates(column, values, split_by)
        return spark.read.jdbc(self.url, table, predicates=predicates, properties={**self.properties(), "fetchsize": str(FETCH_SIZE)})

    def exists(self, spark: SparkSession, table: str) -> bool:
        """Whether the table is there; a failing connection is an error, not an answer."""
        try:
            return bool(self.read(spark, table).columns)
        except AnalysisException as error:
            if _not_found(error):
                return False
            raise
        except Py4JJavaError as error:
            if NO_SUCH_TABLE in str(error.java_exception):
                return False
            raise


def commits_of(table: str) -> str:
    return f"{table}_commits"


def borders_query(table: str, column: str, parts: int) -> str:
    """The values at the ends of ``parts`` equal parts, as a query of the database; frequent ones repeat."""
    shares = ", ".join(repr(k / parts) for k in range(1, parts))
    return (
        f"(SELECT unnest(percentile_disc(ARRAY[{shares}]::double precision[]) WITHIN GROUP (ORDER BY {column})) AS border "
        f"FROM {table}) AS borders"
    )


def _sql_value(value: object) -> str:
    if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
        return "'" + str(value).replace("'", "''") + "'"
    return str(value)


def slice_predicates(column: str, borders: Sequence[object], split_by: str | None = None) -> list[str]:
    """Conditions of which exactly one holds for every row, whatever its value.

    ``borders`` are quantiles in any order, repeated where a value is frequent. A part goes from
    above one border up to the next; a value that is a border ``m`` times, twice or more, is
    apart, in ``m`` parts if ``split_by`` is given.
    """
    counts = Counter(border for border in borders if border is not None)
    ends = sorted(counts)
    out, low = [f"{column} IS NULL"], None
    for end in ends:
        value, frequent = _sql_value(end), counts[end] > 1
        above = [] if low is None else [f"{column} > {low}"]
        out.append(" AND ".join([*above, f"{column} {'<' if frequent else '<='} {value}"]))
        if frequent and split_by is not None:
            rest = f"abs(mod({split_by}, {counts[end]}))"
            out += [f"{column} = {value} AND coalesce({rest}, 0) = {k}" for k in range(counts[end])]
        elif frequent:
            out.append(f"{column} = {value}")
        low = value
    out.append(f"{column} IS NOT NULL" if low is None else f"{column} > {low}")
    return out


def _not_found(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _marked(df: DataFrame, query: str, batch: int) -> DataFrame:
    return df.withColumn("query_id", F.lit(query)).withColumn("batch_id", F.lit(batch).cast("long"))


def _of_batch(table: DataFrame, query: str, batch: int) -> DataFrame:
    return table.where((F.col("query_id") == query) & (F.col("batch_id") == batch)).limit(1)


@dataclass(frozen=True)
class FileTables:
    """The same tables as parquet folders below one path."""

    folder: str

    def path(self, table: str) -> str:
        """A table's folder; a path with ``=`` names a partition of one."""
        return f"{self.folder.rstrip('/')}/{table}" + ("" if "=" in table else ".parquet")

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(self.path(table))

    def write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        df.write.mode(mode).option("compression", "snappy").parquet(self.path(table))

    def write_batch(self, df: DataFrame, table: str, query: str, batch: int) -> None:
        """Write a micro-batch to a folder of its own, which a repetition overwrites."""
        self.write(df, f"{table}.parquet/query_id={query}/batch_id={batch}", "overwrite")

    def exists(self, spark: SparkSession, table: str) -> bool:
        try:
            return bool(self.read(spark, table).columns)
        except AnalysisException as error:
            if _not_found(error):
                return False
            raise


@dataclass(frozen=True)
class CatalogTables:
    """Tables of the session catalogue.

    ``buckets`` maps a table to (number, column): tables bucketed alike on their join key
    join and aggregate on it without another shuffle.
    """

    database: str | None = None
    buckets: dict[str, tuple[int, str]] = field(default_factory=dict)

    def name(self, table: str) -> str:
        return table if self.database is None else f"{self.database}.{table}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.table(self.name(table))

    def write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        writer = df.write.mode(mode)
        if table in self.buckets:
            number, column = self.buckets[table]
            # One shuffle here, so that every task writes whole buckets and not a file for each.
            writer = df.repartition(number, column).write.mode(mode).bucketBy(number, column).sortBy(column)
        writer.saveAsTable(self.name(table))

    def write_batch(self, df: DataFrame, table: str, query: str, batch: int) -> None:
        """Replace the partition of a micro-batch."""
        spark = df.sparkSession
        if not self.exists(spark, table):
            _marked(df, query, batch).write.partitionBy("query_id", "batch_id").saveAsTable(self.name(table))
            return
        own = [c for c in spark.table(self.name(table)).columns if c not in ("query_id", "batch_id")]
        selected = ", ".join(f"`{c}`" for c in own)
        spark.sql(
            f"INSERT OVERWRITE TABLE {self.name(table)} PARTITION (query_id = '{query}', batch_id = {batch}) "
            f"SELECT {selected} FROM {{rows}}",
            rows=df,
        )

    def exists(self, spark: SparkSession, table: str) -> bool:
        return spark.catalog.tableExists(self.name(table))


TableStore = JdbcTables | FileTables | CatalogTables


def load(store: TableStore, spark: SparkSession, *names: str) -> list[DataFrame]:
    return [store.read(spark, name) for name in names]


def save_run(
    spark: SparkSession,
    store: TableStore,
    job: str,
    results: dict[str, DataFrame],
    run_date: datetime,
    status: str = "completed",
) -> None:
    """Append one summary row to ``analytics_runs``, with all reports as one JSON object.

    For reports only: tables of a few hundred rows by construction (top-k lists, rows per
    day, per category or per cluster). Tables that grow with the data are written on
    their own.
    """
    parts = [
        df.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("row")) for name, df in results.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    per_report = rows.groupBy("name").agg(F.collect_list("row").alias("rows"))
    row = per_report.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "rows")))).alias("results_json")
    ).select(
        F.lit(run_date).cast("timestamp").alias("run_date"),
        F.lit(job).alias("job_type"),
        "results_json",
        F.lit(status).alias("status"),
    )
    store.write(row, "analytics_runs", "append")
