"""The daily analytics run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from agora.ml import success, topics
from agora.operators import ideas as idea_jobs
from agora.operators import users as user_jobs
from agora.operators import votes as vote_jobs
from agora.sources.tables import TableStore, load, save_run

USER_COLUMNS = ("ideas_created", "avg_comments_received")
VOTE_COLUMNS = ("total_votes_cast", "upvotes_given", "downvotes_given")


def daily_reports(
    ideas: DataFrame, votes: DataFrame, comments: DataFrame, as_of: datetime | str
) -> dict[str, DataFrame]:
    """Voting trends, idea performance and user engagement as lazy reports."""
    performance = idea_jobs.idea_performance(ideas, votes, comments)
    engagement = user_jobs.author_engagement(ideas, votes, comments)
    return {
        "daily_trends": vote_jobs.daily_trend(votes),
        "peak_hours": vote_jobs.peak_hours(votes),
        "trending_ideas": vote_jobs.fastest_ideas(votes, as_of),
        "top_ideas": idea_jobs.top_ideas(performance).select("idea_id", "title", "engagement_score", "net_score"),
        "category_performance": idea_jobs.category_performance(performance),
        "overall_stats": idea_jobs.overall_performance(performance),
        "most_active_users": user_jobs.most_active_users(engagement),
        "engagement_distribution": idea_jobs.numeric_summary(
            user_jobs.idea_authors(ideas, comments), USER_COLUMNS
        ),
        "voting_patterns": idea_jobs.numeric_summary(vote_jobs.user_votes(votes), VOTE_COLUMNS),
    }


def run_daily(
    spark: SparkSession, store: TableStore, as_of: datetime, with_models: bool = True
) -> dict[str, DataFrame]:
    """All daily reports, topic clusters and the success model; one summary row is stored."""
    ideas, votes, comments = load(store, spark, "ideas", "votes", "comments")
    reports = daily_reports(ideas, votes, comments, as_of)
    if with_models:
        clusters = topics.cluster_topics(ideas)
        reports["cluster_topics"] = clusters.terms
        reports["cluster_sizes"] = clusters.sizes
        trained = success.train_popularity(ideas, votes)
        reports["model_metrics"] = trained.metrics(spark)
    save_run(spark, store, "daily_analytics", reports, as_of)
    return reports
