import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from agora.operators import quantiles, skew

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    """Half of the rows belong to one key; times repeat, so ties matter."""
    rng = random.Random(1)
    rows = [
        ("hot" if i % 2 else f"k{rng.randrange(40)}", T0 + timedelta(seconds=rng.randrange(400)), i, rng.random())
        for i in range(2000)
    ]
    return spark.createDataFrame(rows, "k string, t timestamp, i long, v double").cache()


def test_buckets_hold_alike_with_stray_times_and_bursts(spark):
    stray = [(0, datetime(1970, 1, 1))]
    burst = [(k, T0 + timedelta(microseconds=k)) for k in range(900)]
    wide = [(k, T0 + timedelta(days=k)) for k in range(100)]
    table = spark.createDataFrame(stray + burst + wide + [(1, None)], "i long, t timestamp")
    sizes = [r["count"] for r in skew.with_time_bucket(table, "t", 100).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 200
    assert skew.with_time_bucket(table, "t", 2000) is None


@pytest.mark.parametrize("rows_per_bucket", [10**6, 300, 17])
def test_history_over_buckets_equals_one_window(log, rows_per_bucket):
    def columns(w):
        frame = w.rowsBetween(-4, 0)
        return {
            "before": F.lag("v").over(w),
            "mean": F.when(F.count("v").over(frame) == 5, F.avg("v").over(frame)),
        }

    got = skew.over_history(log, ["k"], "t", ["i"], ["v"], 4, columns, rows_per_bucket)
    plain = log.withColumns(columns(Window.partitionBy("k").orderBy("t", "i")))
    pick = lambda df: {r.i: (r.before, r.mean) for r in df.collect()}
    one, two = pick(got), pick(plain)
    assert one.keys() == two.keys() and len(one) == 2000
    for key, (before, mean) in one.items():
        assert before == two[key][0]
        assert mean == pytest.approx(two[key][1]) if mean is not None else two[key][1] is None


@pytest.mark.parametrize("rows_per_bucket", [10**6, 100])
def test_running_count_equals_row_number(log, rows_per_bucket):
    none = F.lit(None)
    log = log.withColumn("k", F.when(F.col("i") % 5 == 0, none).otherwise(F.col("k")))
    log = log.withColumn("t", F.when(F.col("i") % 7 == 0, none).otherwise(F.col("t")))
    got = skew.with_running_count(log, ["k"], "t", ["i"], "n", rows_per_bucket)
    plain = log.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "i")))
    assert {r.i: r.n for r in got.collect()} == {r.i: r.n for r in plain.collect()}


@pytest.mark.parametrize("shape", ["uniform", "heavy", "ties", "constant"])
def test_large_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(3)
    data = {
        "uniform": rng.random(60_000),
        "heavy": rng.lognormal(0, 4, 60_000),
        "ties": np.where(rng.random(60_000) < 0.34, 1.0, rng.integers(0, 50, 60_000)).astype(float),
        "constant": np.full(30_000, 2.5),
    }[shape]
    df = spark.createDataFrame([(float(x),) for x in data], "x double")
    got = quantiles.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got == pytest.approx(list(np.quantile(data, [0, 0.25, 0.5, 0.75, 1])))


def test_outliers_lose_null_rows_and_later_columns_see_the_rest(spark):
    rows = [(float(i), float(i)) for i in range(20)] + [(1000.0, 5.0), (None, 3.0), (4.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    kept = quantiles.drop_outliers(df, ["a", "missing", "b"])
    assert kept.count() == 20
    assert quantiles.drop_outliers_approx(df, ["a", "b"]).count() == 20


def test_no_values_no_rows(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert quantiles.exact_quantiles(df, "a", [0.5]) == [None]
    assert quantiles.drop_outliers(df, ["a"]).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [10**6, 40])
def test_sessions_over_buckets(spark, rows_per_bucket):
    from agora.operators.users import user_sessions

    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"u{i % 5}", T0 + timedelta(minutes=rng.randrange(20_000)), "view") for i in range(600)]
    # Pauses of exactly the gap.
    rows += [("edge", T0 + timedelta(minutes=30 * i), "like") for i in range(4)]
    table = spark.createDataFrame(rows, "user_id string, timestamp timestamp, interaction_type string")
    got = {(r.user_id, r.start_time): (r.end_time, r.interactions) for r in user_sessions(table, rows_per_bucket=rows_per_bucket).collect()}
    expected = {}
    for user in {r[0] for r in rows}:
        times = sorted(r[1] for r in rows if r[0] == user)
        start = last = times[0]
        count = 0
        for t in times:
            if t > last + timedelta(minutes=30):
                start, count = t, 0
            last, count = t, count + 1
            expected[(user, start)] = (last, count)
    assert got == expected


ODD = {
    "huge": [1e-300, 1e300, -1e300, 3.0, 1.7e308, -1.7e308, 0.0, 5e-324],
    "infinite": [float("-inf"), float("-inf"), 1.0, 2.0, float("inf")],
    "equal": [4.0] * 9,
    "one": [7.0],
}


@pytest.mark.parametrize("name", list(ODD))
def test_ranks_of_odd_values(spark, name):
    data = ODD[name]
    df = spark.createDataFrame([(x,) for x in [*data, None, float("nan")]], "x double")
    total, found = quantiles.values_at_ranks(df, "x", [0.5], lambda n: list(range(n)))
    assert total == len(data) and [one.value for one in found] == sorted(data)
    assert [one.below for one in found] == [sum(x < y for x in data) for y in sorted(data)]


def test_ranks_of_many_values_need_no_large_task(spark):
    """Three million distinct values: what is shuffled and collected are bucket counts only."""
    rows = 3_000_000
    df = spark.range(rows).select(((F.col("id") * 7_919) % rows).cast("double").alias("x"))
    counted = []
    inner = quantiles._counted

    def watched(*args):
        out = inner(*args)
        counted.append(sum(map(len, out)))
        return out

    quantiles._counted = watched
    try:
        assert quantiles.exact_quantiles(df, "x", [0.25, 0.75]) == [(rows - 1) / 4, (rows - 1) * 0.75]
    finally:
        quantiles._counted = inner
    assert len(counted) <= 2 and max(counted) <= 2 * (quantiles.BUCKETS + 2)
