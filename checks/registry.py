"""Registration of queries together with their SQL.

A query names its output columns once, as ``name:kind`` words, and both sides are cast
accordingly. Kinds: i integer, f double (six digits), m large sum (two digits), t time (text), d date (text),
s string, b boolean, l list of strings joined by ``|``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agora.sources.adapter import GivenTables
from checks.domain_sql import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_column(name: str, kind: str) -> Column:
    column = F.col(name)
    match kind:
        case "i":
            return column.cast("bigint").alias(name)
        case "f":
            return (F.round(column.cast("double"), 6) + F.lit(0.0)).alias(name)
        case "m":
            return F.round(column.cast("double"), 2).alias(name)
        case "t":
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)
        case "d":
            return F.date_format(column, "yyyy-MM-dd").alias(name)
        case "l":
            return F.concat_ws("|", column).alias(name)
        case "s":
            return column.cast("string").alias(name)
        case "b":
            return column.cast("boolean").alias(name)
    raise ValueError(kind)


def _sql_column(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    match kind:
        case "i":
            return f"CAST({quoted} AS BIGINT) AS {quoted}"
        case "f":
            return f"round(CAST({quoted} AS DOUBLE), 6) + 0.0::DOUBLE AS {quoted}"
        case "m":
            return f"round(CAST({quoted} AS DOUBLE), 2) AS {quoted}"
        case "t":
            return f"strftime({quoted}, '%Y-%m-%d %H:%M:%S') AS {quoted}"
        case "d":
            return f"strftime({quoted}, '%Y-%m-%d') AS {quoted}"
        case "l" | "s":
            return f"CAST({quoted} AS VARCHAR) AS {quoted}"
        case "b":
            return f"CAST({quoted} AS BOOLEAN) AS {quoted}"
    raise ValueError(kind)


def query(name: str, columns: str, sql: str | None = None):
    """Register ``function(tables) -> DataFrame`` under a name, with optional SQL."""
    spec = [tuple(word.split(":")) for word in columns.split()]

    def register(function: Callable[[GivenTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = function(GivenTables(spark, folder))
            return result.select(*[_spark_column(n, k) for n, k in spec])

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            selected = ", ".join(_sql_column(n, k) for n, k in spec)
            ORACLES[name] = with_tables(f"SELECT {selected} FROM ({sql.strip()}) AS result")
        return function

    return register
