"""User, interaction and network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.operators import ideas as idea_jobs
from agora.operators import users as jobs
from agora.operators import votes as vote_jobs
from agora.plans import daily
from agora.sources.adapter import AS_OF
from checks.registry import query


def analytics_of(t):
    return jobs.user_analytics(t.rated_ideas, t.votes, t.comments)


@query(
    "user_analytics",
    "user_id:s ideas_created:i ideas_published:i ideas_implemented:i avg_votes_per_idea:f total_votes_cast:i"
    " upvotes_given:i downvotes_given:i ratings_given:i avg_rating_given:f positivity_ratio:f comments_made:i"
    " unique_ideas_commented:i engagement_level:s user_score:i",
    "SELECT * FROM user_analytics",
)
def _(t):
    return analytics_of(t)


@query(
    "top_performers",
    "user_id:s rank:i user_score:i ideas_created:i ideas_implemented:i total_votes_cast:i comments_made:i"
    " engagement_level:s",
    """SELECT *, row_number() OVER (ORDER BY user_score DESC, user_id) AS rank FROM user_analytics
       ORDER BY user_score DESC, user_id LIMIT 100""",
)
def _(t):
    return jobs.top_performers(analytics_of(t))


@query(
    "active_user_count",
    "active_users:i",
    """SELECT count(*) AS active_users FROM user_analytics
       WHERE ideas_created > 0 OR total_votes_cast > 0 OR comments_made > 0""",
)
def _(t):
    return jobs.active_user_count(analytics_of(t))


@query(
    "user_vote_patterns",
    "user_id:s total_votes_cast:i upvotes_given:i downvotes_given:i ratings_given:i avg_rating_given:f positivity_ratio:f",
    """SELECT user_id, count(*) AS total_votes_cast, count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes_given,
              count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes_given, count(rating) AS ratings_given,
              avg(rating) AS avg_rating_given,
              CASE WHEN count(*) FILTER (WHERE vote_type = 'downvote') > 0
                   THEN count(*) FILTER (WHERE vote_type = 'upvote') / (count(*) FILTER (WHERE vote_type = 'downvote'))::DOUBLE
                   ELSE count(*) FILTER (WHERE vote_type = 'upvote') END AS positivity_ratio
       FROM large_votes GROUP BY user_id""",
)
def _(t):
    return vote_jobs.user_votes(t.large_votes)


AUTHORS = """SELECT user_id, coalesce(ideas_created, 0) AS ideas_created,
                    coalesce(avg_comments_received, 0) AS avg_comments_received, coalesce(votes_cast, 0) AS votes_cast,
                    coalesce(upvotes_given, 0) AS upvotes_given, coalesce(downvotes_given, 0) AS downvotes_given,
                    coalesce(ideas_created, 0) * 5 + coalesce(votes_cast, 0) AS engagement_score
             FROM (SELECT user_id, count(*) AS ideas_created, avg(coalesce(n, 0)) AS avg_comments_received
                   FROM ideas LEFT JOIN (SELECT idea_id, count(*) AS n FROM active_comments GROUP BY idea_id) USING (idea_id)
                   GROUP BY user_id)
             FULL JOIN (SELECT user_id, count(*) AS votes_cast, count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes_given,
                               count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes_given
                        FROM votes GROUP BY user_id) USING (user_id)"""
AUTHOR_COLUMNS = (
    "user_id:s ideas_created:i avg_comments_received:f votes_cast:i upvotes_given:i downvotes_given:i engagement_score:i"
)


@query("author_engagement", AUTHOR_COLUMNS, AUTHORS)
def _(t):
    return jobs.author_engagement(t.ideas, t.votes, t.comments)


@query("most_active_users", AUTHOR_COLUMNS, AUTHORS + " ORDER BY engagement_score DESC, user_id LIMIT 20")
def _(t):
    return jobs.most_active_users(jobs.author_engagement(t.ideas, t.votes, t.comments))


@query(
    "engagement_distribution",
    "column:s count:i mean:f stddev:f min:f max:f",
    f"""WITH a AS ({AUTHORS.replace('FULL JOIN (SELECT user_id, count(*) AS votes_cast', 'LEFT JOIN (SELECT user_id, count(*) AS votes_cast')})
        SELECT 'ideas_created' AS "column", count(*) AS "count", avg(ideas_created) AS mean, stddev_samp(ideas_created) AS stddev,
               min(ideas_created) AS min, max(ideas_created) AS max FROM a
        UNION ALL
        SELECT 'avg_comments_received', count(*), avg(avg_comments_received), stddev_samp(avg_comments_received),
               min(avg_comments_received), max(avg_comments_received) FROM a""",
)
def _(t):
    return daily.daily_reports(t.rated_ideas, t.votes, t.comments, AS_OF)["engagement_distribution"]


@query(
    "voting_pattern_summary",
    "column:s count:i mean:f stddev:f min:f max:f",
    """WITH u AS (SELECT user_id, count(*) AS a, count(*) FILTER (WHERE vote_type = 'upvote') AS b,
                         count(*) FILTER (WHERE vote_type = 'downvote') AS c FROM votes GROUP BY user_id)
       SELECT 'total_votes_cast' AS "column", count(*) AS "count", avg(a) AS mean, stddev_samp(a) AS stddev, min(a) AS min, max(a) AS max FROM u
       UNION ALL SELECT 'upvotes_given', count(*), avg(b), stddev_samp(b), min(b), max(b) FROM u
       UNION ALL SELECT 'downvotes_given', count(*), avg(c), stddev_samp(c), min(c), max(c) FROM u""",
)
def _(t):
    return daily.daily_reports(t.rated_ideas, t.votes, t.comments, AS_OF)["voting_patterns"]


@query(
    "user_cohorts",
    "user_id:s first_idea:t cohort:s",
    f"""SELECT user_id, min(created_at) AS first_idea,
               CASE WHEN min(created_at) >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAYS THEN 'new' ELSE 'returning' END AS cohort
        FROM ideas GROUP BY user_id""",
)
def _(t):
    return jobs.user_cohorts(t.ideas, AS_OF, days=20)


@query(
    "user_activity",
    "user_id:s ideas_created:i votes_cast:i comments_made:i last_activity:t",
    """SELECT u.user_id, coalesce(i.n, 0) AS ideas_created, coalesce(v.n, 0) AS votes_cast, coalesce(c.n, 0) AS comments_made,
              u.last_activity
       FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, max(ts) AS last_activity FROM events GROUP BY 1) u
       LEFT JOIN (SELECT user_id, count(*) AS n FROM ideas GROUP BY 1) i USING (user_id)
       LEFT JOIN (SELECT user_id, count(*) AS n FROM votes GROUP BY 1) v USING (user_id)
       LEFT JOIN (SELECT user_id, count(*) AS n FROM active_comments GROUP BY 1) c USING (user_id)""",
)
def _(t):
    happened = t.events.select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("created_at"))
    return jobs.user_activity(t.users, t.ideas, t.votes, t.comments, happened)


EDGES = """SELECT a.user_id AS source, i.user_id AS target, count(*) AS interactions
           FROM (SELECT idea_id, user_id FROM votes UNION ALL SELECT idea_id, user_id FROM active_comments) a
           JOIN ideas i USING (idea_id) WHERE a.user_id <> i.user_id GROUP BY ALL"""


@query("interaction_edges", "source:s target:s interactions:i", EDGES)
def _(t):
    return jobs.interaction_edges(t.ideas, t.votes, t.comments)


@query(
    "user_influence",
    "user_id:s out_degree:i given:i in_degree:i received:i",
    f"""WITH e AS ({EDGES})
        SELECT user_id, coalesce(out_degree, 0) AS out_degree, coalesce(given, 0) AS given,
               coalesce(in_degree, 0) AS in_degree, coalesce(received, 0) AS received
        FROM (SELECT source AS user_id, count(*) AS out_degree, sum(interactions) AS given FROM e GROUP BY 1)
        FULL JOIN (SELECT target AS user_id, count(*) AS in_degree, sum(interactions) AS received FROM e GROUP BY 1)
        USING (user_id)""",
)
def _(t):
    return jobs.influence(jobs.interaction_edges(t.ideas, t.votes, t.comments))


@query(
    "interaction_counters",
    "user_id:s interaction_type:s interaction_count:i",
    "SELECT user_id, interaction_type, count(*) AS interaction_count FROM interactions GROUP BY ALL",
)
def _(t):
    return jobs.interaction_counters(t.interactions)


@query(
    "interaction_milestones",
    "user_id:s timestamp:t total_interactions:i",
    """SELECT * FROM (SELECT user_id, "timestamp",
                             row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS total_interactions
                      FROM interactions) WHERE total_interactions % 10 = 0""",
)
def _(t):
    return jobs.milestones(t.interactions)


@query(
    "user_sessions",
    "user_id:s start_time:t end_time:t page_views:i interactions:i duration_seconds:i",
    """SELECT user_id, min("timestamp") AS start_time, max("timestamp") AS end_time,
              count(*) FILTER (WHERE trim(lower(interaction_type)) = 'view') AS page_views, count(*) AS interactions,
              floor(epoch_us(max("timestamp")) / 1e6::DOUBLE - epoch_us(min("timestamp")) / 1e6::DOUBLE) AS duration_seconds
       FROM (SELECT *, sum(CASE WHEN previous IS NULL OR "timestamp" - previous >= INTERVAL 12 HOURS THEN 1 ELSE 0 END)
                       OVER (PARTITION BY user_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING) AS session
             FROM (SELECT *, lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp") AS previous FROM interactions))
       GROUP BY user_id, session""",
)
def _(t):
    return jobs.user_sessions(t.interactions, gap="12 hours")


@query(
    "weekly_active_users",
    "active_users:i",
    "SELECT count(*) AS active_users FROM user_analytics WHERE ideas_created + total_votes_cast + comments_made > 0",
)
def _(t):
    from agora.plans import batch

    return batch.weekly_report(t.rated_ideas, t.votes, t.comments, AS_OF)["active_users_count"]


@query(
    "daily_report_overall",
    "avg_upvote_ratio:f avg_engagement:f",
    "SELECT avg(upvote_ratio) AS avg_upvote_ratio, avg(engagement_score) AS avg_engagement FROM performance",
)
def _(t):
    return daily.daily_reports(t.rated_ideas, t.votes, t.comments, AS_OF)["overall_stats"]


@query(
    "comments_per_user",
    "user_id:s comments_made:i unique_ideas_commented:i",
    """SELECT user_id, count(*) AS comments_made, count(DISTINCT idea_id) AS unique_ideas_commented
       FROM active_comments GROUP BY user_id""",
)
def _(t):
    return jobs.comments_per_user(t.comments)


@query(
    "authors",
    "user_id:s ideas_created:i avg_comments_received:f",
    """SELECT user_id, count(*) AS ideas_created, avg(coalesce(n, 0)) AS avg_comments_received
       FROM ideas LEFT JOIN (SELECT idea_id, count(*) AS n FROM active_comments GROUP BY idea_id) USING (idea_id)
       GROUP BY user_id""",
)
def _(t):
    return jobs.idea_authors(t.ideas, t.comments)


@query(
    "summary_of_ideas",
    "column:s count:i mean:f stddev:f min:f max:f",
    """SELECT 'view_count' AS "column", count(view_count) AS "count", avg(view_count) AS mean, stddev_samp(view_count) AS stddev,
              min(view_count) AS min, max(view_count) AS max FROM ideas""",
)
def _(t):
    return idea_jobs.numeric_summary(t.ideas, ["view_count"])
