"""User analytics, rankings and the interaction network."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from agora.functions import scores, timeparts
from agora.operators import ideas as idea_jobs
from agora.operators import skew
from agora.operators import votes as vote_jobs


def ideas_per_user(ideas: DataFrame) -> DataFrame:
    return ideas.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("ideas_created"),
        F.count_if(F.col("status") == "published").alias("ideas_published"),
        F.count_if(F.col("status") == "implemented").alias("ideas_implemented"),
        F.avg("vote_count").alias("avg_votes_per_idea"),
    )


def comments_per_user(comments: DataFrame) -> DataFrame:
    return (
        idea_jobs.active_comments(comments)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("comments_made"),
            F.count_distinct("idea_id").alias("unique_ideas_commented"),
        )
    )


def user_analytics(ideas: DataFrame, votes: DataFrame, comments: DataFrame) -> DataFrame:
    """Contribution, voting and commenting per user; users of any one source are kept."""
    return (
        ideas_per_user(ideas)
        .join(vote_jobs.user_votes(votes), "user_id", "full")
        .join(comments_per_user(comments), "user_id", "full")
        .fillna(0)
        .withColumn(
            "engagement_level", scores.activity_level("ideas_created", "total_votes_cast", "comments_made")
        )
        .withColumn(
            "user_score",
            scores.user_score("ideas_created", "ideas_implemented", "total_votes_cast", "comments_made"),
        )
    )


def top_performers(analytics: DataFrame, metric: str = "user_score", n: int = 100) -> DataFrame:
    """The ``n`` best users with their rank.

    The top-k comes first, so the global row number sees ``n`` rows only.
    """
    best = analytics.orderBy(F.desc(metric), "user_id").limit(n)
    kept = ["ideas_created", "ideas_implemented", "total_votes_cast", "comments_made", "engagement_level"]
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), "user_id"))).select(
        "user_id", "rank", metric, *[c for c in kept if c != metric]
    )


def active_user_count(analytics: DataFrame) -> DataFrame:
    active = (F.col("ideas_created") > 0) | (F.col("total_votes_cast") > 0) | (F.col("comments_made") > 0)
    return analytics.where(active).agg(F.count(F.lit(1)).alias("active_users"))


def idea_authors(ideas: DataFrame, comments: DataFrame) -> DataFrame:
    """Ideas per author and the mean number of comments they received."""
    received = idea_jobs.with_comment_count(ideas, comments)
    return received.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("ideas_created"), F.avg("comments_count").alias("avg_comments_received")
    )


def author_engagement(ideas: DataFrame, votes: DataFrame, comments: DataFrame) -> DataFrame:
    """Authors and voters joined in full, with five points per idea and one per vote."""
    voters = votes.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("votes_cast"),
        F.count_if(F.col("vote_type") == "upvote").alias("upvotes_given"),
        F.count_if(F.col("vote_type") == "downvote").alias("downvotes_given"),
    )
    return (
        idea_authors(ideas, comments)
        .join(voters, "user_id", "full")
        .fillna(0)
        .withColumn("engagement_score", scores.author_engagement("ideas_created", "votes_cast"))
    )


def most_active_users(engagement: DataFrame, n: int = 20) -> DataFrame:
    return engagement.orderBy(F.desc("engagement_score"), "user_id").limit(n)


def user_cohorts(ideas: DataFrame, as_of: datetime | str, days: int = 7) -> DataFrame:
    """First idea per user; users whose first idea is recent are new, others returning."""
    first = ideas.groupBy("user_id").agg(F.min("created_at").alias("first_idea"))
    return first.withColumn(
        "cohort", F.when(F.col("first_idea") >= timeparts.days_before(as_of, days), "new").otherwise("returning")
    )


def user_activity(
    users: DataFrame, ideas: DataFrame, votes: DataFrame, comments: DataFrame, events: DataFrame
) -> DataFrame:
    """Ideas, votes, comments and the last event per account, each counted on its own first."""
    per_ideas = ideas.groupBy("user_id").agg(F.count(F.lit(1)).alias("ideas_created"))
    per_votes = votes.groupBy("user_id").agg(F.count(F.lit(1)).alias("votes_cast"))
    per_comments = idea_jobs.active_comments(comments).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("comments_made")
    )
    last = events.groupBy("user_id").agg(F.max("created_at").alias("last_activity"))
    return (
        users.select("user_id")
        .join(per_ideas, "user_id", "left")
        .join(per_votes, "user_id", "left")
        .join(per_comments, "user_id", "left")
        .join(last, "user_id", "left")
        .fillna(0, ["ideas_created", "votes_cast", "comments_made"])
    )


def interaction_edges(ideas: DataFrame, votes: DataFrame, comments: DataFrame) -> DataFrame:
    """Who votes or comments on whose ideas, with the number of interactions.

    Actions are counted per (user, idea) before the join with the authors; the adaptive
    skew join splits a hot idea over several tasks.
    """
    def actions(df: DataFrame) -> DataFrame:
        return df.groupBy("idea_id", F.col("user_id").alias("source")).agg(F.count(F.lit(1)).alias("n"))

    acted = (
        actions(votes)
        .unionByName(actions(idea_jobs.active_comments(comments)))
        .groupBy("idea_id", "source")
        .agg(F.sum("n").alias("n"))
    )
    authors = ideas.select("idea_id", F.col("user_id").alias("target"))
    return (
        acted.join(authors, "idea_id")
        .where(F.col("source") != F.col("target"))
        .groupBy("source", "target")
        .agg(F.sum("n").alias("interactions"))
    )


def influence(edges: DataFrame) -> DataFrame:
    """In- and out-degree and received interactions per user."""
    def end(user: str, out: int) -> Column:
        n, none = F.col("interactions"), F.lit(0).cast("long")
        return F.struct(
            F.col(user).alias("user_id"),
            F.lit(out).alias("out_degree"),
            (n if out else none).alias("given"),
            F.lit(1 - out).alias("in_degree"),
            (none if out else n).alias("received"),
        )

    # Both ends of an edge from one pass over the edges.
    ends = edges.select(F.inline(F.array(end("source", 1), end("target", 0))))
    return ends.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in ("out_degree", "given", "in_degree", "received")]
    )


def interaction_counters(interactions: DataFrame) -> DataFrame:
    """Interactions per user and type, matched on the exact user."""
    return interactions.groupBy("user_id", "interaction_type").agg(F.count(F.lit(1)).alias("interaction_count"))


def milestones(interactions: DataFrame, every: int = 10, tie: str = "event_id") -> DataFrame:
    """The interactions that complete each further ``every`` of a user."""
    counted = skew.with_running_count(interactions, ["user_id"], "timestamp", [tie], "total_interactions")
    return counted.where(F.col("total_interactions") % every == 0).select(
        "user_id", "timestamp", "total_interactions"
    )


def user_sessions(
    interactions: DataFrame, gap: str = "30 minutes", rows_per_bucket: int = skew.ROWS_PER_BUCKET
) -> DataFrame:
    """Sessions split by inactivity: views, interactions and duration. Batch or stream.

    A session window sends all rows of a user to one task. A large batch is therefore cut
    into time buckets first; what is left to be merged over the bucket borders is at most
    one session per gap and user.
    """
    bucketed = None if interactions.isStreaming else skew.with_time_bucket(interactions, "timestamp", rows_per_bucket)
    if bucketed is None:
        sessions = _sessions(interactions, gap, [])
    else:
        parts = _sessions(bucketed, gap, ["_bucket"])
        by_time = Window.partitionBy("user_id").orderBy("start_time")
        pause_over = F.col("start_time") > F.lag("end_time").over(by_time) + F.expr(f"INTERVAL {gap}")
        numbered = parts.withColumn("_new", F.when(F.coalesce(pause_over, F.lit(True)), 1).otherwise(0)).withColumn(
            "_session", F.sum("_new").over(by_time)
        )
        sessions = numbered.groupBy("user_id", "_session").agg(
            F.min("start_time").alias("start_time"),
            F.max("end_time").alias("end_time"),
            F.sum("page_views").alias("page_views"),
            F.sum("interactions").alias("interactions"),
        )
    return sessions.select(
        "user_id",
        "start_time",
        "end_time",
        "page_views",
        "interactions",
        timeparts.whole_seconds_between("start_time", "end_time").alias("duration_seconds"),
    )


def _sessions(interactions: DataFrame, gap: str, extra_keys: list[str]) -> DataFrame:
    kind = F.lower(F.trim("interaction_type"))
    return interactions.groupBy(F.session_window("timestamp", gap), "user_id", *extra_keys).agg(
        F.count_if(kind == "view").alias("page_views"),
        F.count(F.lit(1)).alias("interactions"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
    )
