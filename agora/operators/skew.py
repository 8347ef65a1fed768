"""Ordered windows that hold when one key owns a large share of the rows.

Plain aggregations need none of this: Spark combines on the map side first. Joins need
none either: the session's adaptive skew join splits the partition of a hot key. But a
window over raw rows sends all rows of a key to one task; the functions here cut time
into buckets, so that a key is spread over them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

ROWS_PER_BUCKET = 1_000_000
# The borders of the buckets are part of the plan; a larger table gets larger buckets.
MOST_BUCKETS = 10_000


def with_time_bucket(df: DataFrame, time: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame | None:
    """Adds ``_bucket``, the number of a stretch of time that holds about ``rows_per_bucket`` rows.

    The borders are quantiles of the time, so stray times and bursts don't fill a bucket;
    only rows of one instant stay together. Rows without a time belong to the first bucket.
    ``None`` for a table that one bucket can hold.
    """
    rows = df.count()
    if rows <= rows_per_bucket:
        return None
    parts = min(math.ceil(rows / rows_per_bucket), MOST_BUCKETS)
    micros = F.unix_micros(F.col(time)).cast("double")
    shares = [k / parts for k in range(1, parts)]
    borders = df.agg(F.percentile_approx(micros, shares, max(10_000, 20 * parts))).first()[0]
    splits = [-math.inf, *sorted(set(borders or [])), math.inf]
    # Times before all borders stand for a missing time.
    numbered = df.withColumn("_micros", F.coalesce(micros, F.lit(-1e300)))
    return Bucketizer(splits=splits, inputCol="_micros", outputCol="_bucket").transform(numbered).drop("_micros")


def over_history(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str],
    needs: Sequence[str],
    depth: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Window columns that look back at most ``depth`` rows, without one task per key.

    A large table is cut into time buckets. The last ``depth`` rows before a bucket are
    added to it as lead-in rows, the window runs per (key, bucket), and the lead-in
    rows are dropped again. ``columns(window)`` returns the new columns; they may use
    the columns in ``needs`` only, over ``window``, which is ordered by ``time``, ``tie``.
    """
    order = [time, *tie]
    rows = with_time_bucket(df, time, rows_per_bucket)
    if rows is None:
        return df.withColumns(dict(columns(Window.partitionBy(*keys).orderBy(*order))))
    carried = [c for c in dict.fromkeys([*order, *needs]) if c not in keys]
    latest_first = Window.partitionBy(*keys, "_bucket").orderBy(*[F.col(c).desc() for c in order])
    tails = (
        rows.select(*keys, "_bucket", *carried)
        .withColumn("_back", F.row_number().over(latest_first))
        .where(F.col("_back") <= depth)
    )
    # At most ``depth`` rows per bucket are left, so this window per key stays small.
    last_rows = Window.partitionBy(*keys).orderBy("_bucket", *order).rowsBetween(1 - depth, 0)
    carry_out = (
        tails.withColumn("_lead", F.collect_list(F.struct(*carried)).over(last_rows))
        .where(F.col("_back") == 1)
        .select(*keys, "_bucket", "_lead")
    )
    per_key = Window.partitionBy(*keys).orderBy("_bucket")
    lead_in = (
        carry_out.withColumn("_lead", F.lag("_lead").over(per_key))
        .select(*keys, "_bucket", F.inline("_lead"))
        .withColumn("_own", F.lit(False))
    )
    window = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = rows.withColumn("_own", F.lit(True)).unionByName(lead_in, allowMissingColumns=True)
    return out.withColumns(dict(columns(window))).where("_own").drop("_own", "_bucket")


def with_running_count(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str],
    name: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Position of each row within its key by time, counted per (key, bucket) plus an offset.

    Rows without a key are a key of their own.
    """
    rows = with_time_bucket(df, time, rows_per_bucket)
    if rows is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(time, *tie)))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *[F.col(key).alias(f"_of_{key}") for key in keys],
            F.col("_bucket").alias("_of_bucket"),
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    same = F.col("_bucket") == F.col("_of_bucket")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(time, *tie)
    return (
        rows.withColumn("_pos", F.row_number().over(within))
        .join(offsets, same)
        .withColumn(name, F.col("_before") + F.col("_pos"))
        .drop("_before", "_pos", "_bucket", "_of_bucket", *[f"_of_{key}" for key in keys])
    )
