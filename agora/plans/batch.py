"""Batch tables: idea metrics, user analytics, top performers, categories, weekly report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from agora.operators import ideas as idea_jobs
from agora.operators import users as user_jobs
from agora.sources.tables import TableStore, load


def weekly_report(
    ideas: DataFrame, votes: DataFrame, comments: DataFrame, as_of: datetime | str
) -> dict[str, DataFrame]:
    """The four parts of the weekly report. Top ideas count the last week's activity only."""
    week = idea_jobs.idea_metrics(ideas, votes, comments, as_of, lookback_days=7)
    analytics = user_jobs.user_analytics(ideas, votes, comments)
    overall = idea_jobs.idea_metrics(ideas, votes, comments, as_of)
    return {
        "weekly_trend": idea_jobs.weekly_trend(ideas, as_of),
        "top_ideas": idea_jobs.top_ideas_of_week(week),
        "active_users_count": user_jobs.active_user_count(analytics),
        "category_insights": idea_jobs.category_insights(overall),
    }


def run_batch_jobs(spark: SparkSession, store: TableStore, as_of: datetime | str) -> list[str]:
    """Compute and overwrite the four batch tables.

    Idea metrics and user analytics are written first; what builds on them reads the
    written tables back, so nothing is computed twice.
    """
    ideas, votes, comments = load(store, spark, "ideas", "votes", "comments")
    store.write(idea_jobs.idea_metrics(ideas, votes, comments, as_of), "idea_metrics_batch", "overwrite")
    store.write(user_jobs.user_analytics(ideas, votes, comments), "user_analytics_batch", "overwrite")
    metrics, analytics = load(store, spark, "idea_metrics_batch", "user_analytics_batch")
    store.write(user_jobs.top_performers(analytics), "top_performers_batch", "overwrite")
    store.write(idea_jobs.category_insights(metrics), "category_insights_batch", "overwrite")
    return ["idea_metrics_batch", "user_analytics_batch", "top_performers_batch", "category_insights_batch"]
