"""Idea, category and organisation queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from agora.functions import scores, text, timeparts
from agora.ml import features
from agora.operators import ideas as jobs
from agora.plans import batch
from agora.sources.adapter import AS_OF
from checks.registry import query


def metrics_of(t):
    return jobs.idea_metrics(t.rated_ideas, t.votes, t.comments, AS_OF)


@query(
    "idea_metrics",
    "idea_id:i days_since_created:i is_recent:b upvote_count:i downvote_count:i rating_count:i avg_rating:f"
    " rating_stddev:f total_votes:i unique_voters:i comment_count:i unique_commenters:i engagement_score:f"
    " discussion_rate:f controversy_score:f",
    "SELECT * FROM idea_metrics",
)
def _(t):
    return metrics_of(t)


@query(
    "idea_metrics_last_week",
    "idea_id:i total_votes:i unique_voters:i comment_count:i",
    f"""SELECT idea_id, coalesce(v.n, 0) AS total_votes, coalesce(v.u, 0) AS unique_voters, coalesce(c.n, 0) AS comment_count
        FROM ideas
        LEFT JOIN (SELECT idea_id, count(*) AS n, count(DISTINCT user_id) AS u FROM votes
                   WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS GROUP BY idea_id) v USING (idea_id)
        LEFT JOIN (SELECT idea_id, count(*) AS n FROM active_comments
                   WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS GROUP BY idea_id) c USING (idea_id)""",
)
def _(t):
    return jobs.idea_metrics(t.rated_ideas, t.votes, t.comments, AS_OF, lookback_days=7)


@query(
    "top_engaging_ideas",
    "idea_id:i category:s engagement_score:f controversy_score:f total_votes:i avg_rating:f",
    "SELECT * FROM idea_metrics ORDER BY engagement_score DESC, idea_id LIMIT 20",
)
def _(t):
    return jobs.top_ideas(metrics_of(t), 20)


@query(
    "idea_performance",
    "idea_id:i total_votes:i upvotes:i downvotes:i comment_count:i upvote_ratio:f net_score:i engagement_score:i",
    "SELECT * FROM performance",
)
def _(t):
    return jobs.idea_performance(t.ideas, t.votes, t.comments)


@query(
    "top_performing_ideas",
    "idea_id:i engagement_score:i net_score:i upvote_ratio:f",
    "SELECT * FROM performance ORDER BY engagement_score DESC, idea_id LIMIT 20",
)
def _(t):
    return jobs.top_ideas(jobs.idea_performance(t.ideas, t.votes, t.comments))


@query(
    "category_performance",
    "category:s avg_upvote_ratio:f avg_engagement:f idea_count:i",
    """SELECT category, avg(upvote_ratio) AS avg_upvote_ratio, avg(engagement_score) AS avg_engagement,
              count(*) AS idea_count FROM performance GROUP BY category""",
)
def _(t):
    return jobs.category_performance(jobs.idea_performance(t.ideas, t.votes, t.comments))


@query(
    "overall_performance",
    "avg_upvote_ratio:f avg_engagement:f",
    "SELECT avg(upvote_ratio) AS avg_upvote_ratio, avg(engagement_score) AS avg_engagement FROM performance",
)
def _(t):
    return jobs.overall_performance(jobs.idea_performance(t.ideas, t.votes, t.comments))


INSIGHTS = """SELECT *, implemented_count / total_ideas::DOUBLE AS implementation_rate,
                     dense_rank() OVER (ORDER BY avg_engagement_score DESC) AS category_rank
              FROM (SELECT category, count(*) AS total_ideas, avg(upvote_count) AS avg_upvotes,
                           avg(downvote_count) AS avg_downvotes, avg(avg_rating) AS overall_avg_rating,
                           avg(engagement_score) AS avg_engagement_score, avg(comment_count) AS avg_comments,
                           count(*) FILTER (WHERE status = 'implemented') AS implemented_count,
                           count(*) FILTER (WHERE is_recent) AS recent_ideas
                    FROM idea_metrics GROUP BY category)"""


@query(
    "category_insights",
    "category:s total_ideas:i avg_upvotes:f avg_downvotes:f overall_avg_rating:f avg_engagement_score:f avg_comments:f"
    " implemented_count:i recent_ideas:i implementation_rate:f category_rank:i",
    INSIGHTS,
)
def _(t):
    return jobs.category_insights(metrics_of(t))


@query(
    "weekly_idea_trend",
    "week:s ideas_created:i ideas_published:i",
    f"""SELECT CASE WHEN created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS THEN 'current' ELSE 'previous' END AS week,
               count(*) AS ideas_created, count(*) FILTER (WHERE status = 'published') AS ideas_published
        FROM ideas WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS GROUP BY ALL""",
)
def _(t):
    return batch.weekly_report(t.rated_ideas, t.votes, t.comments, AS_OF)["weekly_trend"]


@query(
    "top_ideas_of_week",
    "idea_id:i category:s user_name:s upvote_count:i downvote_count:i avg_rating:f comment_count:i engagement_score:f",
    f"""WITH v AS (SELECT idea_id, count(*) FILTER (WHERE vote_type = 'upvote') AS up,
                          count(*) FILTER (WHERE vote_type = 'downvote') AS down, count(rating) AS n, avg(rating) AS r
                   FROM votes WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS GROUP BY idea_id),
             c AS (SELECT idea_id, count(*) AS n FROM active_comments
                   WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS GROUP BY idea_id)
        SELECT idea_id, category, user_name, coalesce(up, 0) AS upvote_count, coalesce(down, 0) AS downvote_count,
               coalesce(r, 0) AS avg_rating, coalesce(c.n, 0) AS comment_count,
               coalesce(up * 2 + v.n * 1.5 - down, 0) AS engagement_score
        FROM ideas LEFT JOIN v USING (idea_id) LEFT JOIN c USING (idea_id)
        ORDER BY engagement_score DESC, idea_id LIMIT 10""",
)
def _(t):
    return batch.weekly_report(t.rated_ideas, t.votes, t.comments, AS_OF)["top_ideas"]


@query(
    "recent_idea_flags",
    "idea_id:i days_since_created:i is_recent:b week:s",
    f"""SELECT idea_id, date_diff('day', created_at::DATE, DATE '2024-01-31') AS days_since_created,
               date_diff('day', created_at::DATE, DATE '2024-01-31') <= 7 AS is_recent,
               CASE WHEN created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS THEN 'current' ELSE 'previous' END AS week
        FROM ideas""",
)
def _(t):
    return jobs.with_age(t.ideas, AS_OF).withColumn("week", timeparts.week_label("created_at", AS_OF))


@query(
    "recent_ideas",
    "idea_id:i days_since_created:i",
    "SELECT * FROM idea_metrics WHERE days_since_created <= 7",
)
def _(t):
    return jobs.with_age(t.ideas, AS_OF).where("days_since_created <= 7")


@query(
    "idea_search",
    "idea_id:i status:s category:s",
    """SELECT * FROM ideas WHERE status = 'published' AND category = 'innovation'
       AND (contains(lower(title), 'on the') OR contains(lower(description), 'on the'))""",
)
def _(t):
    return jobs.search_ideas(t.ideas, status="published", category="innovation", search="On The")


@query(
    "idea_search_by_tags_and_dates",
    "idea_id:i created_at:t",
    """SELECT * FROM ideas WHERE (lang IN ('de', 'src3') OR source IN ('de', 'src3'))
       AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
def _(t):
    return jobs.search_ideas(
        t.ideas, tags=["de", "src3"], date_from="2024-01-05 00:00:00", date_to="2024-01-20 00:00:00"
    )


@query(
    "idea_listing_page",
    "idea_id:i vote_count:i comments_count:i total:i total_pages:i",
    """SELECT idea_id, vote_count, coalesce(n, 0) AS comments_count, total, (total + 19) // 20 AS total_pages
       FROM (SELECT *, count(*) OVER () AS total FROM rated_ideas ORDER BY vote_count DESC, idea_id LIMIT 20 OFFSET 20)
       LEFT JOIN (SELECT idea_id, count(*) AS n FROM active_comments GROUP BY idea_id) USING (idea_id)""",
)
def _(t):
    return jobs.list_ideas(t.rated_ideas, t.comments, page=2, page_size=20, sort_by="vote_count")


@query(
    "idea_listing_deep_page",
    "idea_id:i vote_count:i comments_count:i total:i total_pages:i",
    """SELECT idea_id, vote_count, coalesce(n, 0) AS comments_count, total, (total + 9) // 10 AS total_pages
       FROM (SELECT *, count(*) OVER () AS total FROM rated_ideas ORDER BY vote_count DESC, idea_id LIMIT 10 OFFSET 540)
       LEFT JOIN (SELECT idea_id, count(*) AS n FROM active_comments GROUP BY idea_id) USING (idea_id)""",
)
def _(t):
    return jobs.list_ideas(t.rated_ideas, t.comments, page=55, page_size=10, sort_by="vote_count")


@query(
    "idea_listing_among_ties",
    "idea_id:i average_rating:f",
    """SELECT idea_id, average_rating FROM rated_ideas ORDER BY average_rating NULLS FIRST, idea_id LIMIT 50 OFFSET 300""",
)
def _(t):
    return jobs.list_ideas(t.rated_ideas, t.comments, page=7, page_size=50, sort_by="average_rating", descending=False)


@query(
    "idea_listing_after",
    "idea_id:i created_at:t",
    """SELECT idea_id, created_at FROM ideas
       WHERE created_at < TIMESTAMP '2024-01-15 12:30:00' OR (created_at = TIMESTAMP '2024-01-15 12:30:00' AND idea_id > 300)
       ORDER BY created_at DESC, idea_id LIMIT 25""",
)
def _(t):
    return jobs.ideas_after(t.ideas, datetime(2024, 1, 15, 12, 30), 300, size=25)


@query(
    "ideas_with_comment_count",
    "idea_id:i comments_count:i",
    """SELECT idea_id, count(c.comment_id) AS comments_count
       FROM ideas LEFT JOIN active_comments c USING (idea_id) GROUP BY idea_id""",
)
def _(t):
    return jobs.with_comment_count(t.ideas, t.comments)


@query(
    "active_comments",
    "comment_id:i idea_id:i user_id:s created_at:t",
    "SELECT * FROM active_comments",
)
def _(t):
    return jobs.comments_newest_first(t.comments)


@query(
    "comment_metrics",
    "idea_id:i comment_count:i unique_commenters:i",
    "SELECT * FROM comment_metrics",
)
def _(t):
    return jobs.comment_metrics(t.comments)


@query(
    "idea_stats",
    "idea_id:i status:s total_votes:i upvotes:i downvotes:i comment_count:i score:i",
    "SELECT *, net_score AS score FROM performance",
)
def _(t):
    return jobs.idea_stats(t.ideas, t.votes, t.comments)


@query(
    "organization_analytics",
    "organization_id:i name:s member_count:i total_ideas:i published_ideas:i decision_sessions:i avg_idea_score:f",
    """SELECT n_nationkey AS organization_id, n_name AS name, coalesce(m.n, 0) AS member_count, coalesce(i.n, 0) AS total_ideas,
              coalesce(i.p, 0) AS published_ideas, coalesce(s.n, 0) AS decision_sessions, i.a AS avg_idea_score
       FROM nation
       LEFT JOIN (SELECT c_nationkey AS k, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1) m ON m.k = n_nationkey
       LEFT JOIN (SELECT idea_id % 25 AS k, count(*) AS n, count(*) FILTER (WHERE status = 'published') AS p,
                         avg(coalesce(upvote_count - downvote_count, 0)) AS a
                  FROM ideas LEFT JOIN totals USING (idea_id) GROUP BY 1) i ON i.k = n_nationkey
       LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey""",
)
def _(t):
    return jobs.organization_analytics(t.organizations, t.members, t.organization_ideas, t.votes, t.sessions)


@query(
    "user_portfolios",
    "user_id:s idea_id:i status:s total_votes:i avg_rating:f comment_count:i engagement_score:f needs_attention:b",
    """SELECT *, total_votes = 0 AND comment_count = 0 AND status NOT IN ('implemented', 'rejected') AS needs_attention
       FROM idea_metrics""",
)
def _(t):
    return jobs.portfolio(metrics_of(t))


@query(
    "visible_ideas",
    "idea_id:i user_id:s status:s",
    "SELECT * FROM ideas WHERE status <> 'draft' OR user_id = '40'",
)
def _(t):
    return jobs.visible_ideas(t.ideas, "40")


@query(
    "content_views",
    "content_id:s view_count:i unique_viewers:i",
    """SELECT content_id, count(*) AS view_count, count(DISTINCT user_id) AS unique_viewers
       FROM interactions WHERE trim(lower(interaction_type)) = 'view' GROUP BY content_id""",
)
def _(t):
    return jobs.view_counts(t.interactions)


@query(
    "controversial_ideas",
    "idea_id:i category:s upvotes:i downvotes:i controversy_score:f",
    """SELECT * FROM (
       SELECT idea_id, category, upvotes, downvotes,
              CASE WHEN upvotes + downvotes > 0 THEN 0.7 * least(upvotes, downvotes) / (upvotes + downvotes)::DOUBLE
                   + 0.3 * least(coalesce(v, 0) / 4, 1) ELSE 0 END AS controversy_score
       FROM ideas JOIN (SELECT idea_id, count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes,
                               count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes, var_pop(rating) AS v
                        FROM votes GROUP BY idea_id) USING (idea_id))
       WHERE upvotes + downvotes >= 10 AND controversy_score > 0.3""",
)
def _(t):
    return jobs.controversial_ideas(t.ideas, t.votes)


@query(
    "category_averages",
    "category:s avg_votes:f avg_rating:f idea_count:i",
    """SELECT category, avg(vote_count) AS avg_votes, avg(average_rating) AS avg_rating, count(*) AS idea_count
       FROM rated_ideas GROUP BY category""",
)
def _(t):
    return jobs.category_averages(t.rated_ideas)


@query(
    "overall_averages",
    "avg_votes:f avg_rating:f total_views:i",
    "SELECT avg(vote_count) AS avg_votes, avg(average_rating) AS avg_rating, sum(view_count) AS total_views FROM rated_ideas",
)
def _(t):
    return jobs.overall_averages(t.rated_ideas)


@query(
    "innovation_rating",
    "idea_count:i avg_rating:f",
    "SELECT count(*) AS idea_count, avg(average_rating) AS avg_rating FROM rated_ideas WHERE category = 'innovation'",
)
def _(t):
    found = jobs.search_ideas(t.rated_ideas, category="innovation")
    return found.agg(F.count(F.lit(1)).alias("idea_count"), F.avg("average_rating").alias("avg_rating"))


@query(
    "sentiment_by_category",
    "category:s avg_sentiment:f positive_comments:i negative_comments:i",
    """SELECT category, avg(s) AS avg_sentiment, count(*) FILTER (WHERE s > 0.3) AS positive_comments,
              count(*) FILTER (WHERE s < -0.3) AS negative_comments
       FROM (SELECT idea_id, ((length(content) % 21) - 10) / 10.0::DOUBLE AS s FROM active_comments)
       JOIN ideas USING (idea_id) GROUP BY category""",
)
def _(t):
    return jobs.sentiment_by_category(t.ideas, t.comments, (F.length("content") % 21 - 10) / F.lit(10.0))


POSITIVE, NEGATIVE = ("the", "and", "on"), ("la", "de", "le")


@query(
    "comment_word_sentiment",
    "category:s avg_sentiment:f positive_comments:i negative_comments:i",
    """SELECT category, avg(s) AS avg_sentiment, count(*) FILTER (WHERE s > 0.3) AS positive_comments,
              count(*) FILTER (WHERE s < -0.3) AS negative_comments
       FROM (SELECT idea_id, (p - n) / (p + n)::DOUBLE AS s
             FROM (SELECT idea_id, len(list_filter(w, lambda x: x IN ('the', 'and', 'on'))) AS p,
                          len(list_filter(w, lambda x: x IN ('la', 'de', 'le'))) AS n
                   FROM (SELECT idea_id, string_split(lower(regexp_replace(content, '[^a-zA-Z]+', ' ', 'g')), ' ') AS w
                         FROM active_comments)) WHERE p + n > 0)
       JOIN ideas USING (idea_id) GROUP BY category""",
)
def _(t):
    return jobs.sentiment_by_category(t.ideas, t.comments, text.lexicon_sentiment("content", POSITIVE, NEGATIVE))


@query(
    "category_growth",
    "category:s period:t idea_count:i previous_count:i growth_rate:f",
    """SELECT *, CASE WHEN previous_count = 0 THEN 1.0 ELSE (idea_count - previous_count) / previous_count::DOUBLE END AS growth_rate
       FROM (SELECT *, lag(idea_count, 1, 0) OVER (PARTITION BY category ORDER BY period) AS previous_count
             FROM (SELECT category, date_trunc('week', created_at)::TIMESTAMP AS period, count(*) AS idea_count
                   FROM ideas GROUP BY ALL))""",
)
def _(t):
    return jobs.category_growth(t.ideas)


@query(
    "seasonality",
    "month:i row_count:i seasonal_index:f",
    """SELECT month, row_count, row_count / avg(row_count) OVER () AS seasonal_index
       FROM (SELECT month(created_at) AS month, count(*) AS row_count FROM decisions GROUP BY ALL)""",
)
def _(t):
    return jobs.seasonality(t.decisions)


@query(
    "activity_forecast",
    "months_ahead:i slope:f forecast:f",
    """WITH m AS (SELECT year(created_at) * 12 + month(created_at) - 1 AS x, count(*) AS y FROM decisions GROUP BY ALL),
            f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS b, max(x) AS last FROM m)
       SELECT h AS months_ahead, slope, greatest(b + slope * (last + h), 0) AS forecast FROM f, range(1, 4) r(h)""",
)
def _(t):
    return jobs.activity_forecast(t.decisions)


@query(
    "review_ranking",
    "idea_id:i review_score:f",
    "SELECT idea_id, 0.6 * vote_count + 0.4 * average_rating * 10 AS review_score FROM rated_ideas",
)
def _(t):
    return jobs.rank_for_review(t.rated_ideas)


@query(
    "capped_engagement",
    "idea_id:i analytics_score:f voting_score:f ideas_score:f",
    """SELECT idea_id,
              0.3 * least(vote_count / 100.0, 1) + 0.25 * average_rating / 5 + 0.2 * least(view_count / 1000.0, 1)
              + 0.15 * least(comment_count / 50.0, 1) + 0.1 * least(days_since_created / 30.0, 1) AS analytics_score,
              0.3 * least(vote_count / 50.0, 1) + 0.25 * average_rating / 5 + 0.2 * least(view_count / 500.0, 1)
              + 0.15 * least(comment_count / 20.0, 1) + 0.1 * greatest(1 - days_since_created / 30.0, 0.5) AS voting_score,
              0.4 * least(vote_count / 50.0, 1) + 0.3 * average_rating / 5 + 0.2 * least(view_count / 500.0, 1)
              + 0.1 * least(comment_count / 20.0, 1) AS ideas_score
       FROM idea_metrics""",
)
def _(t):
    names = ["vote_count", "average_rating", "view_count", "comment_count", "days_since_created"]
    columns = {n: n for n in names} | {"days_active": "days_since_created"}
    return metrics_of(t).select(
        "idea_id",
        *[scores.capped_engagement(p, columns).alias(f"{p}_score") for p in scores.ENGAGEMENT_PROFILES],
    )


@query(
    "synchronised_totals",
    "idea_id:i vote_count:i average_rating:f",
    "SELECT * FROM rated_ideas",
)
def _(t):
    return t.rated_ideas


@query(
    "vote_sync_report",
    "idea_id:i vote_count:i score:f",
    """SELECT idea_id, coalesce(total_votes, 0) AS vote_count, coalesce(upvote_count - downvote_count, 0) / 20.0 AS score
       FROM ideas LEFT JOIN totals USING (idea_id)""",
)
def _(t):
    return jobs.vote_sync_report(t.ideas, t.votes)


@query(
    "idea_texts",
    "idea_id:i combined_text:s normalised_text:s",
    """SELECT idea_id, title || ' ' || description AS combined_text,
              lower(trim(regexp_replace(title || ' ' || description, '[^a-zA-Z\\s]', '', 'g'), ' ')) AS normalised_text
       FROM ideas""",
)
def _(t):
    return t.ideas.select(
        "idea_id",
        text.combined_text("title", "description").alias("combined_text"),
        text.normalised_text("title", "description").alias("normalised_text"),
    )


@query(
    "popularity_features",
    "idea_id:i title_length:i description_length:i has_question_mark:f hour_created:f",
    """SELECT idea_id, len(regexp_split_to_array(title, '\\s+')) AS title_length,
              len(regexp_split_to_array(description, '\\s+')) AS description_length,
              CASE WHEN contains(title, '?') THEN 1.0 ELSE 0.0 END AS has_question_mark,
              (epoch(created_at)::BIGINT % 86400) / 3600.0 AS hour_created
       FROM ideas""",
)
def _(t):
    return features.popularity_features(t.ideas)


@query(
    "success_features",
    "idea_id:i title_length:i description_length:i days_since_created:i category:s",
    """SELECT idea_id, len(string_split(title, ' ')) AS title_length, len(string_split(description, ' ')) AS description_length,
              days_since_created, category FROM idea_metrics""",
)
def _(t):
    return features.success_features(jobs.with_age(t.ideas, AS_OF))


@query(
    "popularity_labels",
    "idea_id:i is_successful:f",
    """SELECT idea_id, CASE WHEN upvotes >= 10 AND upvote_ratio >= 0.7 THEN 1 ELSE 0 END AS is_successful FROM performance""",
)
def _(t):
    from agora.ml import success

    return success.popularity_examples(t.ideas, t.votes)


@query(
    "success_labels",
    "idea_id:i is_successful:f",
    """SELECT idea_id, CASE WHEN status = 'implemented'
              OR engagement_score > 2 * (SELECT avg(engagement_score) FROM idea_metrics) THEN 1 ELSE 0 END AS is_successful
       FROM idea_metrics""",
)
def _(t):
    from agora.ml import success

    return success.success_examples(metrics_of(t))


@query(
    "idea_tokens",
    "idea_id:i token_count:i",
    """SELECT idea_id, len(regexp_split_to_array(lower(title || ' ' || description), '\\s')) AS token_count FROM ideas""",
)
def _(t):
    return features.tokens(t.ideas).withColumn("token_count", F.size("words"))


@query(
    "idea_rule_counts",
    "field:s error_type:s severity:s broken_rows:i",
    """SELECT 'title' AS field, 'length' AS error_type, 'error' AS severity,
              count(*) FILTER (WHERE length(title) NOT BETWEEN 5 AND 200) AS broken_rows FROM ideas
       UNION ALL SELECT 'description', 'length', 'error', count(*) FILTER (WHERE length(description) NOT BETWEEN 20 AND 5000) FROM ideas
       UNION ALL SELECT 'category', 'choice', 'error', 0 FROM (SELECT count(*) FROM ideas)
       UNION ALL SELECT 'tags', 'size', 'error', 0 FROM (SELECT count(*) FROM ideas)""",
)
def _(t):
    from agora.operators import quality

    return quality.rule_counts(t.ideas, quality.idea_rules())


@query(
    "analytics_row_errors",
    "idea_id:i is_valid:b error_count:i warning_count:i",
    """SELECT idea_id, true AS is_valid, 0 AS error_count,
              (length(title) < 3)::INT + (vote_count > 1000)::INT AS warning_count
       FROM rated_ideas""",
)
def _(t):
    from agora.operators import quality

    checked = quality.with_errors(t.rated_ideas, quality.analytics_rules())

    def having(severity):
        return F.size(F.filter("errors", lambda e: e["severity"] == severity))

    return checked.select(
        "idea_id",
        quality.is_valid().alias("is_valid"),
        having("error").alias("error_count"),
        having("warning").alias("warning_count"),
    )


@query(
    "table_counts",
    "table_name:s found:b row_count:i",
    """SELECT 'ideas' AS table_name, true AS found, count(*) AS row_count FROM documents
       UNION ALL SELECT 'votes', true, count(*) FROM votes
       UNION ALL SELECT 'comments', true, count(*) FROM comments
       UNION ALL SELECT 'decisions', true, count(*) FROM orders
       UNION ALL SELECT 'attachments', false, 0""",
)
def _(t):
    return jobs.table_counts(
        {"ideas": t.ideas, "votes": t.votes, "comments": t.comments, "decisions": t.decisions, "attachments": None}
    )


@query(
    "model_input",
    "idea_id:i vote_count:i total_votes:i comment_count:i",
    "SELECT * FROM idea_metrics",
)
def _(t):
    from agora.plans.models import join_metrics

    return join_metrics(t.rated_ideas, metrics_of(t))
