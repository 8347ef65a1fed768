"""Idea, category and organisation metrics, searches and listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from agora.functions import scores, stats, text, timeparts
from agora.operators import votes as vote_jobs
from agora.operators.quantiles import values_at_ranks

SORT_COLUMNS = ("created_at", "vote_count", "average_rating")


def active_comments(comments: DataFrame) -> DataFrame:
    return comments.where(~F.col("is_deleted"))


def comment_metrics(comments: DataFrame, key: str = "idea_id") -> DataFrame:
    """Comments and distinct commenters per idea, deleted comments left out."""
    return (
        active_comments(comments)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("comment_count"),
            F.count_distinct("user_id").alias("unique_commenters"),
        )
    )


def with_age(ideas: DataFrame, as_of: datetime | str) -> DataFrame:
    return ideas.withColumn("days_since_created", timeparts.age_in_days("created_at", as_of)).withColumn(
        "is_recent", timeparts.is_recent("created_at", as_of)
    )


def sync_vote_totals(ideas: DataFrame, votes: DataFrame) -> DataFrame:
    """Ideas with ``vote_count`` and ``average_rating`` taken from their votes."""
    totals = vote_jobs.vote_totals(votes).select(
        "idea_id", F.col("total_votes").alias("vote_count"), "average_rating"
    )
    kept = [c for c in ideas.columns if c not in ("vote_count", "average_rating")]
    return ideas.select(*kept).join(totals, "idea_id", "left").fillna(0, ["vote_count", "average_rating"])


def vote_sync_report(ideas: DataFrame, votes: DataFrame) -> DataFrame:
    """Total votes and the net vote rate per idea, as shown after synchronising."""
    counts = vote_jobs.vote_totals(votes).select("idea_id", "upvote_count", "downvote_count", "total_votes")
    return (
        ideas.select("idea_id")
        .join(counts, "idea_id", "left")
        .fillna(0)
        .select(
            "idea_id",
            F.col("total_votes").alias("vote_count"),
            scores.net_rate("upvote_count", "downvote_count").alias("score"),
        )
    )


def _recent(df: DataFrame, as_of: datetime | str, lookback_days: int | None) -> DataFrame:
    if lookback_days is None:
        return df
    return df.where(F.col("created_at") >= timeparts.days_before(as_of, lookback_days))


def idea_metrics(
    ideas: DataFrame,
    votes: DataFrame,
    comments: DataFrame,
    as_of: datetime | str,
    lookback_days: int | None = None,
) -> DataFrame:
    """Vote, comment and age metrics per idea.

    Votes and comments are aggregated before the joins, so the joins see one row per
    idea on both sides. ``lookback_days`` limits votes and comments, not ideas.
    """
    vote_part = vote_jobs.vote_metrics(_recent(votes, as_of, lookback_days))
    comment_part = comment_metrics(_recent(comments, as_of, lookback_days))
    return (
        with_age(ideas, as_of)
        .join(vote_part, "idea_id", "left")
        .join(comment_part, "idea_id", "left")
        .fillna(
            0,
            [
                "upvote_count",
                "downvote_count",
                "rating_count",
                "total_votes",
                "unique_voters",
                "comment_count",
                "unique_commenters",
                "engagement_score",
                "avg_rating",
                "rating_stddev",
            ],
        )
        .withColumn("discussion_rate", scores.ratio("comment_count", "unique_voters"))
        .withColumn("controversy_score", scores.controversy("downvote_count", "total_votes", "rating_stddev"))
    )


def idea_performance(ideas: DataFrame, votes: DataFrame, comments: DataFrame) -> DataFrame:
    """Vote ratio, net score and discussion engagement per idea."""
    return (
        ideas.join(vote_jobs.vote_counts(votes), "idea_id", "left")
        .join(comment_metrics(comments).select("idea_id", "comment_count"), "idea_id", "left")
        .fillna(0, ["total_votes", "upvotes", "downvotes", "comment_count"])
        .withColumn("upvote_ratio", scores.ratio("upvotes", "total_votes"))
        .withColumn("net_score", scores.net_votes("upvotes", "downvotes"))
        .withColumn("engagement_score", scores.discussion_engagement("total_votes", "comment_count"))
    )


def top_ideas(performance: DataFrame, n: int = 20) -> DataFrame:
    return performance.orderBy(F.desc("engagement_score"), "idea_id").limit(n)


def category_performance(performance: DataFrame) -> DataFrame:
    return (
        performance.groupBy("category")
        .agg(
            F.avg("upvote_ratio").alias("avg_upvote_ratio"),
            F.avg("engagement_score").alias("avg_engagement"),
            F.count(F.lit(1)).alias("idea_count"),
        )
        .orderBy(F.desc("avg_engagement"), "category")
    )


def overall_performance(performance: DataFrame) -> DataFrame:
    return performance.agg(
        F.avg("upvote_ratio").alias("avg_upvote_ratio"), F.avg("engagement_score").alias("avg_engagement")
    )


def category_insights(metrics: DataFrame) -> DataFrame:
    """Averages, implemented and recent ideas per category, ranked by engagement."""
    insights = (
        metrics.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("total_ideas"),
            F.avg("upvote_count").alias("avg_upvotes"),
            F.avg("downvote_count").alias("avg_downvotes"),
            F.avg("avg_rating").alias("overall_avg_rating"),
            F.avg("engagement_score").alias("avg_engagement_score"),
            F.avg("comment_count").alias("avg_comments"),
            F.count_if(F.col("status") == "implemented").alias("implemented_count"),
            F.count_if(F.col("is_recent")).alias("recent_ideas"),
        )
        .withColumn("implementation_rate", scores.ratio("implemented_count", "total_ideas"))
    )
    # One row per category is left, so ranking them in one task is safe.
    return insights.withColumn("category_rank", F.dense_rank().over(Window.orderBy(F.desc("avg_engagement_score"))))


def weekly_trend(ideas: DataFrame, as_of: datetime | str) -> DataFrame:
    """Ideas created and published in this and the previous week."""
    return (
        ideas.where(F.col("created_at") >= timeparts.days_before(as_of, 14))
        .groupBy(timeparts.week_label("created_at", as_of).alias("week"))
        .agg(
            F.count(F.lit(1)).alias("ideas_created"),
            F.count_if(F.col("status") == "published").alias("ideas_published"),
        )
    )


def top_ideas_of_week(metrics: DataFrame, n: int = 10) -> DataFrame:
    return (
        metrics.orderBy(F.desc("engagement_score"), "idea_id")
        .limit(n)
        .select(
            "idea_id",
            "title",
            "category",
            "user_name",
            "upvote_count",
            "downvote_count",
            "avg_rating",
            "comment_count",
            "engagement_score",
        )
    )


def search_ideas(
    ideas: DataFrame,
    status: str | None = None,
    category: str | None = None,
    user_id: str | None = None,
    search: str | None = None,
    tags: Sequence[str] | None = None,
    date_from: datetime | str | None = None,
    date_to: datetime | str | None = None,
) -> DataFrame:
    """Ideas meeting all given conditions; ``search`` is a plain, case-blind substring."""
    found = ideas
    for name, value in (("status", status), ("category", category), ("user_id", user_id)):
        if value is not None:
            found = found.where(F.col(name) == value)
    if search:
        wanted = search.lower()
        found = found.where(
            F.contains(F.lower("title"), F.lit(wanted)) | F.contains(F.lower("description"), F.lit(wanted))
        )
    if tags:
        found = found.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if date_from is not None:
        found = found.where(F.col("created_at") >= timeparts.moment(date_from))
    if date_to is not None:
        found = found.where(F.col("created_at") <= timeparts.moment(date_to))
    return found


def list_ideas(
    ideas: DataFrame,
    comments: DataFrame,
    page: int = 1,
    page_size: int = 20,
    sort_by: str = "created_at",
    descending: bool = True,
) -> DataFrame:
    """One page of ideas with comment counts, the total and the number of pages."""
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {SORT_COLUMNS}")
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page must be positive and page_size between 1 and 100")
    total = ideas.agg(F.count(F.lit(1))).scalar()
    rows = page_rows(ideas, sort_by, descending, (page - 1) * page_size, page_size)
    return (
        with_comment_count(rows, comments)
        .withColumn("total", total)
        .withColumn("total_pages", scores.page_count("total", page_size))
    )


#: Rows before a page up to which they are ordered along with it.
SHALLOW = 200


def _listing_order(sort_by: str, descending: bool) -> list[Column]:
    return [F.desc(sort_by) if descending else F.asc(sort_by), F.asc("idea_id")]


def _number(ideas: DataFrame, sort_by: str) -> Column:
    """A sort column as a number, exact up to 2**53."""
    kind = dict(ideas.dtypes)[sort_by]
    return F.unix_micros(F.col(sort_by).cast("timestamp")) if kind.startswith("timestamp") else F.col(sort_by)


def page_rows(ideas: DataFrame, sort_by: str, descending: bool, offset: int, size: int) -> DataFrame:
    """``size`` rows from place ``offset`` on in the order of a listing; ties by id.

    Far from the start the rows before a page are counted, not gathered: the sort value at
    the place is found by its rank, then the id among the rows of this value, and only rows
    from there on are read and ordered.
    """
    order = _listing_order(sort_by, descending)
    if offset <= SHALLOW:
        return ideas.orderBy(*order).offset(offset).limit(size)
    keyed = ideas.withColumn("_key", _number(ideas, sort_by).cast("double"))
    keyed = keyed.withColumn("_key", F.when(F.isnan("_key"), F.lit(float("inf"))).otherwise(F.col("_key")))
    missing = keyed.where(F.col("_key").isNull())
    # Nulls come last in descending order and first in ascending order.
    empty = missing.count()
    if not descending and offset < empty:
        return _from_id(missing, offset, size, keyed.where(F.col("_key").isNotNull()), order)
    skipped = offset if descending else offset - empty
    there = keyed.where(F.col("_key").isNotNull())

    def place(total: int) -> list[int]:
        return [total - 1 - skipped if descending else skipped] if skipped < total else []

    share = _share(there.count(), skipped, descending)
    total, found = values_at_ranks(there, "_key", [share], place)
    if not found:
        return _from_id(missing, skipped - total, size, None, order) if descending else keyed.drop("_key").limit(0)
    value = found[0].value
    same = there.where(F.col("_key") == value)
    rest = there.where(F.col("_key") < value if descending else F.col("_key") > value)
    if descending:
        before = total - found[0].below - same.count()
        rest = rest.unionByName(missing)
    else:
        before = found[0].below
    return _from_id(same, skipped - before, size, rest, order)


def _share(total: int, skipped: int, descending: bool) -> float:
    share = min(skipped / max(total - 1, 1), 1.0)
    return 1.0 - share if descending else share


def _from_id(same: DataFrame, skipped: int, size: int, rest: DataFrame | None, order: list[Column]) -> DataFrame:
    """A page that starts at place ``skipped``, by id, of rows with one sort value."""
    _, found = values_at_ranks(same, "idea_id", [_share(same.count(), skipped, False)], lambda n: [skipped] if skipped < n else [])
    if not found:
        return same.drop("_key").limit(0)
    rows = same.where(F.col("idea_id") >= found[0].value)
    if rest is not None:
        rows = rows.unionByName(rest)
    # Rows that repeat the id at this place may come before it.
    return rows.drop("_key").orderBy(*order).offset(skipped - found[0].below).limit(size)


def ideas_after(
    ideas: DataFrame, value: object, idea_id: int, size: int = 20, sort_by: str = "created_at", descending: bool = True
) -> DataFrame:
    """The next rows of a listing after the one with this sort value and id (a cursor).

    The filter reaches the scan, so a page costs the same wherever it is. ``value`` may be None.
    """
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {SORT_COLUMNS}")
    column, last = F.col(sort_by), F.lit(value)
    if value is None:
        later = column.isNull() & (F.col("idea_id") > idea_id)
        later = later if descending else later | column.isNotNull()
    else:
        later = (column < last if descending else column > last) | ((column == last) & (F.col("idea_id") > idea_id))
        later = later | column.isNull() if descending else later
    return ideas.where(later).orderBy(*_listing_order(sort_by, descending)).limit(size)


def with_comment_count(ideas: DataFrame, comments: DataFrame) -> DataFrame:
    counts = active_comments(comments).groupBy("idea_id").agg(F.count(F.lit(1)).alias("comments_count"))
    return ideas.join(counts, "idea_id", "left").fillna(0, ["comments_count"])


def comments_newest_first(comments: DataFrame) -> DataFrame:
    return active_comments(comments).orderBy(F.desc("created_at"), F.desc("comment_id"))


def idea_stats(ideas: DataFrame, votes: DataFrame, comments: DataFrame) -> DataFrame:
    """Votes, comments and score per idea; both sides aggregated first so nothing multiplies."""
    return (
        ideas.select("idea_id", "title", "category", "status", "created_at")
        .join(vote_jobs.vote_counts(votes), "idea_id", "left")
        .join(comment_metrics(comments).select("idea_id", "comment_count"), "idea_id", "left")
        .fillna(0, ["total_votes", "upvotes", "downvotes", "comment_count"])
        .withColumn("score", scores.net_votes("upvotes", "downvotes"))
    )


def organization_analytics(
    organizations: DataFrame, members: DataFrame, ideas: DataFrame, votes: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Members, ideas, sessions and the mean idea score per organisation."""
    key = "organization_id"
    scored = ideas.join(vote_jobs.idea_scores(votes), "idea_id", "left").fillna(0, ["score"])
    per_ideas = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_ideas"),
        F.count_if(F.col("status") == "published").alias("published_ideas"),
        F.avg("score").alias("avg_idea_score"),
    )
    per_members = members.groupBy(key).agg(F.count_distinct("user_id").alias("member_count"))
    per_sessions = sessions.groupBy(key).agg(F.count(F.lit(1)).alias("decision_sessions"))
    return (
        organizations.join(per_members, key, "left")
        .join(per_ideas, key, "left")
        .join(per_sessions, key, "left")
        .fillna(0, ["member_count", "total_ideas", "published_ideas", "decision_sessions"])
    )


def portfolio(metrics: DataFrame, user_id: str | None = None) -> DataFrame:
    """A user's ideas (or everybody's) with status, metrics and whether they need attention."""
    mine = metrics if user_id is None else metrics.where(F.col("user_id") == user_id)
    quiet = (F.col("total_votes") == 0) & (F.col("comment_count") == 0)
    return mine.select(
        "user_id",
        "idea_id",
        "title",
        "status",
        "total_votes",
        "avg_rating",
        "comment_count",
        "engagement_score",
        (quiet & ~F.col("status").isin("implemented", "rejected")).alias("needs_attention"),
    )


def visible_ideas(ideas: DataFrame, user_id: str) -> DataFrame:
    """Everything but drafts, plus the user's own drafts."""
    return ideas.where((F.col("status") != "draft") | (F.col("user_id") == user_id))


def view_counts(interactions: DataFrame) -> DataFrame:
    """Views and distinct viewers per content item."""
    views = interactions.where(text.strip(F.lower("interaction_type")) == "view")
    return views.groupBy("content_id").agg(
        F.count(F.lit(1)).alias("view_count"), F.count_distinct("user_id").alias("unique_viewers")
    )


def controversial_ideas(
    ideas: DataFrame, votes: DataFrame, threshold: float = 0.3, min_votes: int = 10
) -> DataFrame:
    """Ideas whose vote split and rating spread call for an escalation."""
    rating = F.when(F.col("vote_type") == "rating", F.col("rating"))
    spread = votes.groupBy("idea_id").agg(
        F.count_if(F.col("vote_type") == "upvote").alias("upvotes"),
        F.count_if(F.col("vote_type") == "downvote").alias("downvotes"),
        F.var_pop(rating).alias("rating_variance"),
    )
    return (
        ideas.select("idea_id", "title", "category")
        .join(spread, "idea_id")
        .withColumn("controversy_score", scores.polarisation("upvotes", "downvotes", "rating_variance"))
        .where((F.col("upvotes") + F.col("downvotes") >= min_votes) & (F.col("controversy_score") > threshold))
        .select("idea_id", "category", "upvotes", "downvotes", "controversy_score")
    )


def category_averages(ideas: DataFrame) -> DataFrame:
    return ideas.groupBy("category").agg(
        F.avg("vote_count").alias("avg_votes"),
        F.avg("average_rating").alias("avg_rating"),
        F.count(F.lit(1)).alias("idea_count"),
    )


def overall_averages(ideas: DataFrame) -> DataFrame:
    return ideas.agg(
        F.avg("vote_count").alias("avg_votes"),
        F.avg("average_rating").alias("avg_rating"),
        F.sum("view_count").alias("total_views"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum, one row per column."""
    aggregates: list[Column] = []
    for name in columns:
        value = F.col(name).cast("double")
        aggregates.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(value).alias("count"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("stddev"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
            ).alias(f"_{name}")
        )
    rows = df.agg(*aggregates)
    return rows.select(F.inline(F.array(*[F.col(f"_{name}") for name in columns])))


def sentiment_by_category(ideas: DataFrame, comments: DataFrame, sentiment: Column) -> DataFrame:
    """Mean sentiment of comments per idea category; sums per idea go into the join."""
    per_idea = (
        active_comments(comments)
        .withColumn("sentiment", sentiment)
        .where(F.col("sentiment").isNotNull())
        .groupBy("idea_id")
        .agg(
            F.sum("sentiment").alias("sentiment_sum"),
            F.count(F.lit(1)).alias("rated"),
            F.count_if(text.sentiment_category("sentiment") == "positive").alias("positive"),
            F.count_if(text.sentiment_category("sentiment") == "negative").alias("negative"),
        )
    )
    return (
        ideas.select("idea_id", "category")
        .join(per_idea, "idea_id")
        .groupBy("category")
        .agg(
            (F.sum("sentiment_sum") / F.sum("rated")).alias("avg_sentiment"),
            F.sum("positive").alias("positive_comments"),
            F.sum("negative").alias("negative_comments"),
        )
    )


def category_growth(ideas: DataFrame, period: str = "week") -> DataFrame:
    """Ideas per category and period with growth over the period before."""
    counts = ideas.groupBy("category", F.date_trunc(period, "created_at").alias("period")).agg(
        F.count(F.lit(1)).alias("idea_count")
    )
    by_time = Window.partitionBy("category").orderBy("period")
    return counts.withColumn("previous_count", F.lag("idea_count", 1, 0).over(by_time)).withColumn(
        "growth_rate", stats.growth("idea_count", "previous_count")
    )


def seasonality(df: DataFrame, time: str = "created_at") -> DataFrame:
    """Rows per calendar month against the mean over months."""
    monthly = df.groupBy(F.month(time).alias("month")).agg(F.count(F.lit(1)).alias("row_count"))
    # At most twelve rows.
    mean = F.avg("row_count").over(Window.partitionBy())
    return monthly.withColumn("seasonal_index", F.col("row_count") / mean)


def activity_forecast(df: DataFrame, time: str = "created_at", horizon: int = 3) -> DataFrame:
    """Linear trend of monthly counts: slope, intercept and the next months' forecast."""
    month_index = F.year(time) * 12 + F.month(time) - 1
    monthly = df.groupBy(month_index.alias("month_index")).agg(F.count(F.lit(1)).alias("row_count"))
    fit = monthly.agg(
        F.regr_slope("row_count", "month_index").alias("slope"),
        F.regr_intercept("row_count", "month_index").alias("intercept"),
        F.max("month_index").alias("last_month"),
    )
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("months_ahead")
    return fit.select("slope", "intercept", "last_month", ahead).withColumn(
        "forecast",
        F.greatest(
            F.col("intercept") + F.col("slope") * (F.col("last_month") + F.col("months_ahead")), F.lit(0.0)
        ),
    )


def series_trend(series: DataFrame, keys: Sequence[str], order: str, value: str, recent: int = 7) -> DataFrame:
    """Mean of the last ``recent`` points against the mean of all earlier ones, per key.

    ``series`` holds one aggregated point per key and period.
    """
    latest_first = Window.partitionBy(*keys).orderBy(F.desc(order))
    ranked = series.withColumn("_pos", F.row_number().over(latest_first))
    is_recent = F.col("_pos") <= recent
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.sum(F.when(is_recent, F.col(value))), F.lit(0)).cast("double").alias("_recent"),
        F.coalesce(F.sum(F.when(~is_recent, F.col(value))), F.lit(0)).cast("double").alias("_older"),
    )
    older_points = F.greatest(F.col("points") - recent, F.lit(1))
    enough = F.col("points") >= 2
    return (
        out.withColumn("recent_average", F.col("_recent") / F.least(F.col("points"), F.lit(recent)))
        .withColumn("historical_average", F.col("_older") / older_points)
        .withColumn(
            "growth_rate",
            F.when(enough, stats.growth("recent_average", "historical_average")).otherwise(F.lit(0.0)),
        )
        .withColumn("trend", F.when(enough, stats.trend_name("growth_rate")).otherwise("insufficient_data"))
        .drop("_recent", "_older")
    )


def rank_for_review(ideas: DataFrame) -> DataFrame:
    """Ideas by review engagement, best first."""
    return ideas.withColumn(
        "review_score", scores.review_engagement("vote_count", "average_rating")
    ).orderBy(F.desc("review_score"), "idea_id")


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Row count per table; a table that is ``None`` is reported as missing."""
    present = {name: df for name, df in tables.items() if df is not None}
    out: DataFrame | None = None
    for name, df in present.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(True).alias("found"), "row_count"
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no table is present")
    missing = [n for n in tables if n not in present]
    if missing:
        spark = out.sparkSession
        out = out.unionByName(
            spark.createDataFrame([(n, False, 0) for n in missing], "table_name string, found boolean, row_count long")
        )
    return out
