"""Exact order statistics and the interquartile outlier filter on columns of any size.

``percentile`` keeps every distinct value of the column in one task, and a running count over
sorted values would order them in one. Here ranks are found by counting: a sketch narrows the
column to a short stretch around each wanted rank, the rows in it are counted per bucket of
values, and the bucket that holds the rank is cut into buckets again until it holds one value.
A pass returns a few thousand counts, however many rows or distinct values there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Rank error of a sketch is 1/ACCURACY of the rows it saw; stretches are wider than that.
ACCURACY = 50_000
MARGIN = 4.0 / ACCURACY
#: Buckets that a stretch is cut into.
BUCKETS = 4_096


@dataclass(frozen=True)
class Ranked:
    """The value at a rank, and how many rows lie below this value."""

    value: float
    below: int


def values_at_ranks(
    df: DataFrame, column: str | Column, shares: Sequence[float], ranks: Callable[[int], Sequence[int]]
) -> tuple[int, list[Ranked]]:
    """The number of values, and those at some places (from 0) of a column in ascending order.

    ``ranks`` says the places for a number of values; ``shares`` are about where they lie. Nulls
    and NaN are left out. Whole numbers are exact up to 2**53. One pass for the sketch and one
    for each cut: mostly a single one, more where values differ by many orders of magnitude.
    """
    value, finite = F.col("v"), F.abs(F.col("v")) < math.inf
    values = df.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v"))
    values = values.where(value.isNotNull() & ~F.isnan(value))
    edges = [min(max(share + side, 0.0), 1.0) for share in shares for side in (-MARGIN, MARGIN)]
    seen = values.agg(
        F.count_if(finite).alias("n"),
        F.count_if(value == -math.inf).alias("lowest"),
        F.count_if(value == math.inf).alias("highest"),
        F.percentile_approx(F.when(finite, value), edges, ACCURACY).alias("q"),
    ).first()
    total = seen["lowest"] + seen["n"] + seen["highest"]
    found: dict[int, Ranked] = {}
    open_: dict[int, tuple[float, float]] = {}
    wanted = list(ranks(total)) if total else []
    for rank in wanted:
        if rank < seen["lowest"]:
            found[rank] = Ranked(-math.inf, 0)
        elif rank >= seen["lowest"] + seen["n"]:
            found[rank] = Ranked(math.inf, seen["lowest"] + seen["n"])
        else:
            place = (rank - seen["lowest"]) / max(seen["n"] - 1, 1)
            near = min(range(len(shares)), key=lambda k: abs(shares[k] - place))
            open_[rank] = (seen["q"][2 * near], seen["q"][2 * near + 1])
    rows = values.where(finite)
    below = dict.fromkeys(open_, seen["lowest"])
    everywhere = True
    while open_:
        spans = sorted(set(open_.values()))
        counts = _counted(rows, spans, everywhere)
        everywhere = False
        for rank, span in list(open_.items()):
            before = below[rank]
            for n, low, high in counts[spans.index(span)]:
                if rank < before + n:
                    break
                before += n
            below[rank] = before
            if low == high:
                found[rank] = Ranked(low, before)
                del open_[rank]
            else:
                open_[rank] = (low, high)
    return total, [found[rank] for rank in wanted]


def _counted(rows: DataFrame, spans: list[tuple[float, float]], everywhere: bool) -> list[list[tuple[int, float, float]]]:
    """Per span the (number, least, greatest) of each of its buckets, in order.

    With ``everywhere``, what lies below and above a span are two more buckets.
    """
    value, places = F.col("v"), []
    for k, (low, high) in enumerate(spans):
        # Halves, so that a difference can't overflow; the ends lie in different buckets.
        part = F.floor((value / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS) if low < high else F.lit(0)
        bucket = F.when(value.between(low, high), F.least(part.cast("int"), F.lit(BUCKETS - 1)))
        if everywhere:
            bucket = F.when(value < low, -1).when(value > high, BUCKETS).otherwise(bucket)
        places.append(F.when(bucket.isNotNull(), F.struct(F.lit(k).alias("span"), bucket.alias("bucket"))))
    if not everywhere:
        rows = rows.where(_any([value.between(low, high) for low, high in spans]))
    placed = rows.select("v", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p"))
    counts = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    out: list[list[tuple[int, float, float]]] = [[] for _ in spans]
    for row in sorted(counts.collect(), key=lambda r: r["p"]["bucket"]):  # at most BUCKETS + 2 rows a span
        out[row["p"]["span"]].append((row["n"], row["low"], row["high"]))
    return out


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles of a numeric column; nulls and NaN are left out."""

    def ranks(total: int) -> list[int]:
        return [rank for share in shares for rank in (math.floor((total - 1) * share), math.ceil((total - 1) * share))]

    total, found = values_at_ranks(df, column, shares, ranks)
    if not total:
        return [None] * len(shares)
    return [_between((total - 1) * share, found[2 * k].value, found[2 * k + 1].value) for k, share in enumerate(shares)]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def _between(position: float, lower: float, upper: float) -> float:
    """The interpolation of ``percentile``, digit by digit."""
    floor, ceiling = math.floor(position), math.ceil(position)
    if floor == ceiling or lower == upper:
        return lower
    return (ceiling - position) * lower + (position - floor) * upper


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in columns if kinds.get(c) in ("double", "float", "bigint", "int")]


def drop_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows within 1.5 interquartile ranges of the quartiles, one column after the other.

    Later columns see the rows the earlier ones left. Rows with a null in a checked
    column are dropped; columns that are missing or not numeric are skipped. The
    quartiles are computed when this is called; the filter itself stays lazy and, with
    its literal bounds, can reach the scan.
    """
    for name in _numeric(df, columns):
        q1, q3 = exact_quantiles(df, name, [0.25, 0.75])
        if q1 is None:
            return df.where(F.lit(False))
        reach = (q3 - q1) * 1.5
        df = df.where(F.col(name).between(q1 - reach, q3 + reach))
    return df


def drop_outliers_approx(df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY) -> DataFrame:
    """The same filter with sketched quartiles: one pass per column, rank error 1/accuracy."""
    for name in _numeric(df, columns):
        q = df.agg(F.percentile_approx(name, [0.25, 0.75], accuracy).alias("q")).first()["q"]
        if q is None:
            return df.where(F.lit(False))
        reach = (q[1] - q[0]) * 1.5
        df = df.where(F.col(name).between(q[0] - reach, q[1] + reach))
    return df
