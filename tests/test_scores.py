import math

import pytest
from pyspark.sql import functions as F

from agora.functions import scores, stats, text, timeparts


def value(spark, column, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in columns.items()])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "up, down, total, ratings, average, expected",
    [(15, 3, 18, 0, 0.0, 12.0), (10, 2, 12, 5, 4.0, 48.0), (0, 0, 0, 0, 0.0, 0.0), (0, 1, 1, 0, 0.0, -1.0), (0, 0, 0, 2, 4.0, 0.0)],
)
def test_vote_score(spark, up, down, total, ratings, average, expected):
    got = value(spark, scores.vote_score("u", "d", "t", "n", "a"), u=up, d=down, t=total, n=ratings, a=average)
    assert got == expected


@pytest.mark.parametrize(
    "profile, metrics, expected",
    [
        ("analytics", dict(vote_count=75, average_rating=4.5, view_count=800, comment_count=25, days_active=20), 0.751667),
        ("analytics", dict(vote_count=5, average_rating=2.0, view_count=50, comment_count=2, days_active=2), 0.137667),
        ("voting", dict(vote_count=30, average_rating=4.3, view_count=250, comment_count=12, days_since_created=15), 0.635),
        ("ideas", dict(vote_count=25, average_rating=4.2, view_count=150, comment_count=8), 0.552),
    ],
)
def test_capped_engagement(spark, profile, metrics, expected):
    got = value(spark, scores.capped_engagement(profile, {k: k for k in metrics}), **metrics)
    assert got == pytest.approx(expected, abs=1e-6)


def test_review_engagement_orders_ideas(spark):
    ideas = spark.createDataFrame([("a", 25, 4.5), ("b", 18, 4.2), ("c", 30, 4.8)], "title string, vote_count int, average_rating double")
    got = ideas.select("title", scores.review_engagement("vote_count", "average_rating").alias("s")).orderBy(F.desc("s")).collect()
    assert [r.title for r in got] == ["c", "a", "b"]
    assert [r.s for r in got] == pytest.approx([37.2, 33.0, 27.6])


@pytest.mark.parametrize(
    "up, down, ratings, expected",
    [(50, 45, [1, 2, 5, 4, 1, 5, 3, 2, 5, 1], 0.533329), (80, 5, [4, 4, 5, 4, 5, 4, 4, 5, 4, 5], 0.059176), (0, 0, [5, 1], 0.0)],
)
def test_polarisation(spark, up, down, ratings, expected):
    rows = spark.createDataFrame([(float(r),) for r in ratings], "r double").agg(F.var_pop("r").alias("v"))
    got = rows.select(scores.polarisation(F.lit(up), F.lit(down), "v").alias("x")).first()["x"]
    assert got == pytest.approx(expected, abs=1e-6)


def test_decision_impact(spark):
    row = dict(cost=75000.0, revenue=200000.0, p=0.78, risks=["technical", "market"])
    assert value(spark, scores.roi("cost", "revenue"), **row) == pytest.approx(1.666667, abs=1e-6)
    assert value(spark, scores.adjusted_probability("p", "risks"), **row) == pytest.approx(0.68)
    assert value(spark, scores.expected_value("cost", "revenue", "p", "risks"), **row) == pytest.approx(85000)
    assert value(spark, scores.risk_level("risks"), **row) == "medium"


def test_controversy_needs_more_than_ten_votes(spark):
    assert value(spark, scores.controversy("d", "t", "s"), d=5, t=10, s=2.0) == 0.0
    assert value(spark, scores.controversy("d", "t", "s"), d=5, t=11, s=2.0) == pytest.approx(10 / 11)


def test_positivity_and_levels(spark):
    assert value(spark, scores.positivity("u", "d"), u=3, d=0) == 3.0
    assert value(spark, scores.positivity("u", "d"), u=3, d=2) == 1.5
    for total, expected in ((10, "low"), (11, "medium"), (50, "medium"), (51, "high")):
        assert value(spark, scores.activity_level("a", "b"), a=total, b=0) == expected


def test_trending_decays_by_the_hour(spark):
    column = scores.trending("u", "r", "d", F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 10:00:00").cast("timestamp"))
    assert value(spark, column, u=2, r=2, d=1) == pytest.approx(6 * math.exp(-1))


def test_erf_and_z(spark):
    for x in (-1.5, 0.0, 0.3, 2.2):
        assert value(spark, stats.erf(F.col("x")), x=x) == pytest.approx(math.erf(x), abs=2e-7)
    z = value(spark, stats.two_proportion_z("a", "n", "b", "m"), a=123, n=1000, b=157, m=1000)
    pooled = 280 / 2000
    assert z == pytest.approx((0.157 - 0.123) / math.sqrt(pooled * (1 - pooled) * 2 / 1000))


def test_clean_text(spark):
    raw = "  Hello  world!\n see https://x.org/a?b=1 or mail me@x.org  (now) é "
    assert value(spark, text.clean_text("t"), t=raw) == "Hello world! see  or mail  now "
    assert value(spark, text.clean_text(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("raw, words", [("", 0), ("   ", 0), ("a", 1), (" a  b\tc ", 3), ("a b", 2)])
def test_word_count(spark, raw, words):
    assert value(spark, text.word_count("t"), t=raw) == words


def test_token_count_keeps_a_leading_piece(spark):
    assert value(spark, text.token_count("t"), t=" a b") == 3


def test_sentiment(spark):
    for score, name in ((0.31, "positive"), (0.3, "neutral"), (-0.3, "neutral"), (-0.31, "negative")):
        assert value(spark, text.sentiment_category("s"), s=score) == name
    missing = F.lit(None).cast("double")
    assert value(spark, text.sentiment_category(missing)) == "neutral"
    assert value(spark, text.sentiment_category(missing, null_as=None)) is None
    assert value(spark, text.clip(missing)) is None
    assert value(spark, text.clip("s"), s=-1.2) == -1.0


def test_tags(spark):
    tags = [" Work ", "not valid!", "x" * 51, "", "a_b-1"]
    assert value(spark, text.clean_tags("t"), t=tags) == ["work", "a_b-1"]
    assert value(spark, text.leading_tags("t"), t=tags) == tags[:3]
    none = F.lit(None).cast("array<string>")
    assert value(spark, text.tag_count(none)) == 0
    assert value(spark, text.has_tag(none)) is False


def test_label(spark):
    assert value(spark, text.label("n", "i", "r"), n="Ann", i="u1", r="approver") == "Ann (approver)"
    assert value(spark, text.label("n", "i", "r"), n="", i="u1", r="") == "u1 (Unknown)"


def test_time_parts(spark):
    monday = F.lit("2024-01-01 06:30:00").cast("timestamp")
    assert value(spark, timeparts.hour_fraction(monday)) == 6.5
    assert value(spark, timeparts.weekday(monday)) == 0
    assert value(spark, timeparts.is_weekend(F.lit("2024-01-06 00:00:00").cast("timestamp"))) is True
    earlier = F.lit("2024-01-01 06:29:58.5").cast("timestamp")
    assert value(spark, timeparts.whole_seconds_between(monday, earlier)) == 0
    assert value(spark, timeparts.seconds_between(earlier, monday)) == 1.5


def test_hidden_id_is_stable_and_salted(spark):
    one, two = value(spark, text.hidden_id("u", "a"), u="x"), value(spark, text.hidden_id("u", "b"), u="x")
    assert len(one) == 64 and one != two and "x" != one
