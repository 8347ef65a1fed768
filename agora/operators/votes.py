"""Vote aggregates, trends, limits and histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from agora.functions import scores, stats, text, timeparts
from agora.operators import skew

MINUTES_PER_DAY = 1440.0


def _is(kind: str) -> Column:
    return F.col("vote_type") == kind


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _rating() -> Column:
    return F.when(_is("rating"), F.col("rating"))


def vote_counts(votes: DataFrame) -> DataFrame:
    """Total, up- and downvotes per idea."""
    return votes.groupBy("idea_id").agg(
        F.count(F.lit(1)).alias("total_votes"),
        _count(_is("upvote")).alias("upvotes"),
        _count(_is("downvote")).alias("downvotes"),
    )


def vote_metrics(votes: DataFrame) -> DataFrame:
    """Counts per vote type, rating mean and spread, voters and engagement per idea."""
    return (
        votes.groupBy("idea_id")
        .agg(
            _count(_is("upvote")).alias("upvote_count"),
            _count(_is("downvote")).alias("downvote_count"),
            _count(_is("rating")).alias("rating_count"),
            F.avg(_rating()).alias("avg_rating"),
            F.stddev_samp(_rating()).alias("rating_stddev"),
            F.count(F.lit(1)).alias("total_votes"),
            F.count_distinct("user_id").alias("unique_voters"),
        )
        .withColumn(
            "engagement_score", scores.vote_engagement("upvote_count", "rating_count", "downvote_count")
        )
    )


def vote_totals(votes: DataFrame) -> DataFrame:
    """The stored vote aggregate of an idea; ratings count apart and a rating of 0 is no rating."""
    given = F.when(F.col("rating") != 0, _rating())
    return (
        votes.groupBy("idea_id")
        .agg(
            _count(_is("upvote")).alias("upvote_count"),
            _count(_is("downvote")).alias("downvote_count"),
            F.count(given).alias("rating_count"),
            F.coalesce(F.sum(given), F.lit(0.0)).alias("rating_sum"),
        )
        .withColumn("total_votes", F.col("upvote_count") + F.col("downvote_count"))
        .withColumn("average_rating", scores.ratio("rating_sum", "rating_count"))
        .withColumn(
            "score",
            scores.vote_score(
                "upvote_count", "downvote_count", "total_votes", "rating_count", "average_rating"
            ),
        )
    )


def totals_for_ideas(ideas: DataFrame, votes: DataFrame) -> DataFrame:
    """:func:`vote_totals` of every idea, zeros for ideas nobody voted on."""
    return ideas.select("idea_id").join(vote_totals(votes), "idea_id", "left").fillna(0)


def rating_sums(votes: DataFrame) -> DataFrame:
    """Up, down, rating count and rating sum per idea."""
    return votes.groupBy("idea_id").agg(
        _count(_is("upvote")).alias("upvotes"),
        _count(_is("downvote")).alias("downvotes"),
        F.count(_rating()).alias("ratings"),
        F.coalesce(F.sum(_rating()), F.lit(0.0)).alias("rating_sum"),
    )


def idea_scores(votes: DataFrame) -> DataFrame:
    """Up- minus downvotes per idea."""
    return votes.groupBy("idea_id").agg((_count(_is("upvote")) - _count(_is("downvote"))).alias("score"))


def user_votes(votes: DataFrame) -> DataFrame:
    """Voting pattern per user."""
    return (
        votes.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total_votes_cast"),
            _count(_is("upvote")).alias("upvotes_given"),
            _count(_is("downvote")).alias("downvotes_given"),
            _count(_is("rating")).alias("ratings_given"),
            F.avg(_rating()).alias("avg_rating_given"),
        )
        .withColumn("positivity_ratio", scores.positivity("upvotes_given", "downvotes_given"))
    )


def daily_trend(votes: DataFrame) -> DataFrame:
    """Votes per day, oldest first."""
    stamped = votes.withColumn("vote_timestamp", F.to_timestamp("created_at"))
    return (
        stamped.groupBy(F.window("vote_timestamp", "1 day"))
        .agg(
            F.count(F.lit(1)).alias("total_votes"),
            _count(_is("upvote")).alias("upvotes"),
            _count(_is("downvote")).alias("downvotes"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "total_votes",
            "upvotes",
            "downvotes",
        )
        .orderBy("window_start")
    )


def hourly_counts(votes: DataFrame) -> DataFrame:
    """Votes per hour, busiest first."""
    stamped = votes.withColumn("vote_timestamp", F.to_timestamp("created_at"))
    return (
        stamped.groupBy(F.window("vote_timestamp", "1 hour"))
        .agg(F.count(F.lit(1)).alias("votes_count"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "votes_count"
        )
        .orderBy(F.desc("votes_count"), "window_start")
    )


def peak_hours(votes: DataFrame, n: int = 5) -> DataFrame:
    return hourly_counts(votes).limit(n)


def vote_velocity(votes: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    """Votes of the last hours per idea and per minute, fastest first."""
    recent = votes.where(F.col("created_at") > timeparts.hours_before(as_of, hours))
    return (
        recent.groupBy("idea_id")
        .agg(F.count(F.lit(1)).alias("recent_votes"))
        .withColumn("votes_per_minute", F.col("recent_votes") / F.lit(MINUTES_PER_DAY / 24 * hours))
        .orderBy(F.desc("votes_per_minute"), "idea_id")
    )


def fastest_ideas(votes: DataFrame, as_of: datetime | str, n: int = 10) -> DataFrame:
    return vote_velocity(votes, as_of).limit(n)


def voting_stats(votes: DataFrame, as_of: datetime | str, days: int = 7) -> DataFrame:
    """Votes and distinct voters of the last 1 to 30 days, one row."""
    if not 1 <= days <= 30:
        raise ValueError("days must be between 1 and 30")
    since = timeparts.hours_before(as_of, 24 * days)
    return votes.where(F.col("created_at") >= since).agg(
        F.count(F.lit(1)).alias("total_votes_cast"), F.count_distinct("user_id").alias("unique_voters")
    )


def most_voted(votes: DataFrame, n: int = 10) -> DataFrame:
    return vote_totals(votes).orderBy(F.desc("score"), "idea_id").limit(n)


def recent_votes(votes: DataFrame, n: int = 10) -> DataFrame:
    return votes.orderBy(F.desc("created_at"), F.desc("vote_id")).limit(n)


def duplicate_votes(votes: DataFrame) -> DataFrame:
    """(idea, user) pairs with more than one vote."""
    return (
        votes.groupBy("idea_id", "user_id")
        .agg(F.count(F.lit(1)).alias("vote_count"))
        .where(F.col("vote_count") > 1)
    )


def latest_votes(votes: DataFrame) -> DataFrame:
    """The vote that counts per (idea, user): the newest replaces the earlier ones.

    ``max_by`` combines on the map side, unlike a row number over the pair.
    """
    rest = [c for c in votes.columns if c not in ("idea_id", "user_id")]
    changed = F.coalesce(F.col("updated_at"), F.col("created_at")) if "updated_at" in rest else F.col("created_at")
    newest = F.max_by(F.struct(*rest), F.struct(changed, F.col("vote_id"))).alias("_vote")
    return votes.groupBy("idea_id", "user_id").agg(newest).select("idea_id", "user_id", "_vote.*")


def vote_history(votes: DataFrame) -> DataFrame:
    """Every vote with the one it replaced and whether it changed the voter's mind."""
    out = skew.over_history(
        votes,
        keys=["user_id", "idea_id"],
        time="created_at",
        tie=["vote_id"],
        needs=["vote_type"],
        depth=1,
        columns=lambda w: {"previous_vote_type": F.lag("vote_type").over(w)},
    )
    return out.withColumn(
        "is_change",
        F.coalesce(F.col("previous_vote_type") != F.col("vote_type"), F.lit(False)),
    )


def vote_status(votes: DataFrame, user_id: str, idea_ids: Sequence[int]) -> DataFrame:
    """Whether and how one user voted on each of at most 100 requested ideas."""
    if not 1 <= len(idea_ids) <= 100:
        raise ValueError("between 1 and 100 idea ids are allowed")
    spark = votes.sparkSession
    asked = spark.createDataFrame([(i,) for i in dict.fromkeys(idea_ids)], "idea_id int")
    mine = latest_votes(votes.where((F.col("user_id") == user_id) & F.col("idea_id").isin(list(idea_ids))))
    return asked.join(mine, "idea_id", "left").select(
        "idea_id",
        F.col("vote_id").isNotNull().alias("has_voted"),
        "vote_type",
        "rating",
        F.col("created_at").alias("voted_at"),
    )


def vote_status_of_users(ideas: DataFrame, votes: DataFrame, user_id: str) -> DataFrame:
    """The same for all ideas: a left join instead of a list of ids."""
    mine = latest_votes(votes.where(F.col("user_id") == user_id))
    return (
        ideas.select("idea_id")
        .join(mine, "idea_id", "left")
        .select("idea_id", F.col("vote_id").isNotNull().alias("has_voted"), "vote_type", "rating")
    )


def votes_on(votes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Votes on the ideas named by another table.

    Distinct ids make the inner join a semi join that Spark can broadcast or split.
    """
    return votes.join(wanted.select("idea_id").distinct(), "idea_id")


def weighted_scores(votes: DataFrame, experts: DataFrame, expert_weight: float = 1.5) -> DataFrame:
    """Net score per idea with the votes of experts counting more.

    Votes are first reduced to one row per (idea, user), so the join carries counts.
    """
    per_voter = votes.groupBy("idea_id", "user_id").agg(
        _count(_is("upvote")).alias("up"), _count(_is("downvote")).alias("down")
    )
    known = experts.select("user_id").distinct().withColumn("is_expert", F.lit(True))
    marked = per_voter.join(known, "user_id", "left").withColumn(
        "weight", scores.vote_weight("is_expert", expert_weight)
    )
    return marked.groupBy("idea_id").agg(
        F.sum((F.col("up") - F.col("down")) * F.col("weight")).alias("weighted_score"),
        F.sum((F.col("up") + F.col("down")) * F.col("weight")).alias("weighted_votes"),
        F.coalesce(F.sum(F.when(F.col("is_expert"), F.col("up"))), F.lit(0)).alias("expert_endorsements"),
    )


def anonymous(votes: DataFrame, salt: str) -> DataFrame:
    """Votes whose voters are replaced by salted hashes; address and agent are removed."""
    return votes.withColumn("user_id", text.hidden_id("user_id", salt)).drop("ip_address", "user_agent")


def campaign_counts(votes: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Vote counts per idea within a campaign period (start inclusive, end exclusive)."""
    inside = votes.where(
        (F.col("created_at") >= timeparts.moment(start)) & (F.col("created_at") < timeparts.moment(end))
    )
    return vote_counts(inside).withColumn("net_votes", scores.net_votes("upvotes", "downvotes"))


def votes_per_window(votes: DataFrame, window: str = "5 minutes", time: str = "timestamp") -> DataFrame:
    """Tumbling event-time window per idea. Works on batches and on streams alike."""
    return (
        votes.groupBy(F.window(F.col(time), window), "idea_id")
        .agg(
            _count(_is("upvote")).alias("upvotes"),
            _count(_is("downvote")).alias("downvotes"),
            _count(_is("rating")).alias("ratings"),
            F.avg(_rating()).alias("avg_rating"),
            F.count(F.lit(1)).alias("total_events"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "idea_id",
            "upvotes",
            "downvotes",
            "ratings",
            "avg_rating",
            "total_events",
            scores.net_votes("upvotes", "downvotes").alias("net_votes"),
        )
    )


def with_trending_score(windows: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Windows with a positive decayed score, unsorted (legal on streams)."""
    score = scores.trending("upvotes", "ratings", "downvotes", "window_end", timeparts.moment(as_of))
    return windows.withColumn("trending_score", score).where(F.col("trending_score") > 0)


def trending_ideas(windows: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    return with_trending_score(windows, as_of).orderBy(F.desc("trending_score"), "idea_id", "window_start")


def voter_activity(
    votes: DataFrame, window: str = "1 minute", time: str = "timestamp", streaming: bool = False
) -> DataFrame:
    """Votes, distinct ideas and distinct addresses per user and window.

    Streams refuse distinct counts, so there the size of a set stands in: it holds the
    values of one user within one window.
    """
    def distinct(name: str) -> Column:
        return F.size(F.collect_set(name)).cast("long") if streaming else F.count_distinct(name)

    return (
        votes.groupBy(F.window(F.col(time), window), "user_id")
        .agg(
            F.count(F.lit(1)).alias("vote_count"),
            distinct("idea_id").alias("unique_ideas"),
            distinct("ip_address").alias("unique_ips"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "user_id",
            "vote_count",
            "unique_ideas",
            "unique_ips",
        )
    )


def voting_anomalies(
    votes: DataFrame,
    window: str = "1 minute",
    max_votes: int = 20,
    max_ips: int = 5,
    time: str = "timestamp",
    streaming: bool = False,
) -> DataFrame:
    """Users with too many votes or addresses within one window."""
    suspicious = (F.col("vote_count") > max_votes) | (F.col("unique_ips") > max_ips)
    return voter_activity(votes, window, time, streaming).withColumn("is_anomaly", suspicious).where("is_anomaly")


# Kinds of unusual activity: what is counted, per what, the limit and the severity.
ANOMALY_RULES: dict[str, dict[str, object]] = {
    "vote_surge": {"event": "vote", "key": "idea_id", "window": "10 minutes", "limit": 100, "severity": "Medium"},
    "comment_flood": {"event": "comment", "key": "idea_id", "window": "10 minutes", "limit": 50, "severity": "Low"},
    "rapid_voter": {"event": "vote", "key": "user_id", "window": "10 minutes", "limit": 50, "severity": "High"},
}


def activity_anomalies(
    events: Mapping[str, DataFrame], rules: Mapping[str, Mapping[str, object]] = ANOMALY_RULES
) -> DataFrame:
    """Windows in which a rule's event count per key reaches its limit.

    ``events`` maps the event kinds of the rules to tables with ``created_at`` and the
    key column. The result has one row per (rule, key, window).
    """
    out: DataFrame | None = None
    for kind, rule in rules.items():
        key = str(rule["key"])
        found = (
            events[str(rule["event"])]
            .groupBy(F.window("created_at", str(rule["window"])), F.col(key).cast("string").alias("subject"))
            .agg(F.count(F.lit(1)).alias("event_count"))
            .where(F.col("event_count") >= int(rule["limit"]))
            .select(
                F.lit(kind).alias("anomaly_type"),
                F.lit(str(rule["severity"])).alias("severity"),
                "subject",
                F.col("window.start").alias("window_start"),
                "event_count",
            )
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("at least one rule is needed")
    return out


def votes_over_limit(votes: DataFrame, limit: int = 10, window: str = "60 seconds") -> DataFrame:
    """Users above the vote limit per fixed minute, with the number of excess votes.

    Fixed windows approximate the limit whose window starts at a user's first vote;
    the exact rule is the stateful stream ``agora.streaming.stateful.limit_votes``.
    """
    return (
        votes.groupBy(F.window("created_at", window), "user_id")
        .agg(F.count(F.lit(1)).alias("vote_count"))
        .where(F.col("vote_count") > limit)
        .select(
            F.col("window.start").alias("window_start"),
            "user_id",
            "vote_count",
            (F.col("vote_count") - limit).alias("excess_votes"),
        )
    )


def net_from_lifecycle(events: DataFrame) -> DataFrame:
    """Current votes per idea from cast, update and remove events.

    The newest event of a (idea, user) pair decides; a removal leaves no vote.
    """
    newest = events.groupBy("idea_id", "user_id").agg(
        F.max_by(F.struct("event_type", "vote_type", "rating"), F.struct("timestamp", "event_id")).alias("_last")
    )
    return vote_counts(
        newest.select("idea_id", "user_id", "_last.*").where(F.col("event_type") != "vote_removed")
    )


def participation(ideas: DataFrame, votes: DataFrame, users: DataFrame) -> DataFrame:
    """Votes cast, votes per idea and the share of users who voted, one row."""
    cast = votes.agg(
        F.struct(F.count(F.lit(1)).alias("votes"), F.count_distinct("user_id").alias("voters"))
    ).scalar()
    idea_count = ideas.agg(F.count(F.lit(1))).scalar()
    return (
        users.agg(F.count_distinct("user_id").alias("total_users"))
        .withColumn("total_votes", cast["votes"])
        .withColumn("voters", cast["voters"])
        .withColumn("avg_votes_per_idea", scores.ratio("total_votes", idea_count))
        .withColumn("participation_rate", scores.ratio("voters", "total_users"))
    )


def variant_results(votes: DataFrame, exposed: Column, converted: Column, variant: Column) -> DataFrame:
    """Exposures, conversions and conversion rate per experiment variant."""
    return (
        votes.where(exposed)
        .groupBy(variant.alias("variant"))
        .agg(F.count(F.lit(1)).alias("exposures"), F.count_if(converted).alias("conversions"))
        .withColumn("conversion_rate", scores.ratio("conversions", "exposures"))
    )


def compare_variants(results: DataFrame, control: str) -> DataFrame:
    """Each variant against the control: lift, z statistic and confidence."""
    base = (
        results.where(F.col("variant") == control)
        .agg(F.struct(F.sum("exposures").alias("n"), F.sum("conversions").alias("hits")))
        .scalar()
    )
    return (
        results.withColumn("control_exposures", base["n"])
        .withColumn("control_conversions", base["hits"])
        .withColumn(
            "lift",
            stats.growth("conversion_rate", scores.ratio("control_conversions", "control_exposures")),
        )
        .withColumn(
            "z_score",
            stats.two_proportion_z("control_conversions", "control_exposures", "conversions", "exposures"),
        )
        .withColumn("confidence", stats.two_sided_confidence("z_score"))
        .drop("control_exposures", "control_conversions")
    )


def leaderboard(ideas: DataFrame, votes: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best ideas of every category by vote score."""
    ranked = Window.partitionBy("category").orderBy(F.desc("score"), F.desc("total_votes"), "idea_id")
    return (
        ideas.select("idea_id", "title", "category")
        .join(vote_totals(votes), "idea_id", "left")
        .fillna(0, ["score", "total_votes"])
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= n)
        .select("category", "rank", "idea_id", "title", "score", "total_votes")
    )
