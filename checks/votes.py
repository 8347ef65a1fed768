"""Vote queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.functions import scores, text, timeparts
from agora.operators import votes as jobs
from agora.sources.adapter import AS_OF
from checks.registry import query

SALT = "pepper"


@query(
    "votes_per_idea",
    "idea_id:i total_votes:i upvotes:i downvotes:i upvote_ratio:f net_score:i",
    """SELECT idea_id, count(*) AS total_votes, count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes,
              count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes,
              count(*) FILTER (WHERE vote_type = 'upvote') / count(*)::DOUBLE AS upvote_ratio,
              count(*) FILTER (WHERE vote_type = 'upvote') - count(*) FILTER (WHERE vote_type = 'downvote') AS net_score
       FROM votes GROUP BY idea_id""",
)
def _(t):
    return (
        jobs.vote_counts(t.votes)
        .withColumn("upvote_ratio", scores.ratio("upvotes", "total_votes"))
        .withColumn("net_score", scores.net_votes("upvotes", "downvotes"))
    )


METRIC_COLUMNS = (
    "idea_id:i upvote_count:i downvote_count:i rating_count:i avg_rating:f rating_stddev:f total_votes:i"
    " unique_voters:i engagement_score:f"
)


@query(
    "vote_metrics",
    METRIC_COLUMNS,
    "SELECT *, upvote_count * 2 + rating_count * 1.5 - downvote_count AS engagement_score FROM vote_metrics",
)
def _(t):
    return jobs.vote_metrics(t.votes)


@query(
    "vote_metrics_large",
    METRIC_COLUMNS,
    """SELECT *, upvote_count * 2 + rating_count * 1.5 - downvote_count AS engagement_score FROM (
       SELECT idea_id, count(*) FILTER (WHERE vote_type = 'upvote') AS upvote_count,
              count(*) FILTER (WHERE vote_type = 'downvote') AS downvote_count,
              count(*) FILTER (WHERE vote_type = 'rating') AS rating_count, avg(rating) AS avg_rating,
              stddev_samp(rating) AS rating_stddev, count(*) AS total_votes, count(DISTINCT user_id) AS unique_voters
       FROM large_votes GROUP BY idea_id)""",
)
def _(t):
    return jobs.vote_metrics(t.large_votes)


TOTAL_COLUMNS = (
    "idea_id:i upvote_count:i downvote_count:i rating_count:i rating_sum:f total_votes:i average_rating:f score:f"
)


@query("vote_totals", TOTAL_COLUMNS, "SELECT * FROM totals")
def _(t):
    return jobs.vote_totals(t.votes)


@query(
    "vote_totals_of_all_ideas",
    TOTAL_COLUMNS,
    """SELECT idea_id, coalesce(upvote_count, 0) AS upvote_count, coalesce(downvote_count, 0) AS downvote_count,
              coalesce(rating_count, 0) AS rating_count, coalesce(rating_sum, 0) AS rating_sum,
              coalesce(total_votes, 0) AS total_votes, coalesce(average_rating, 0) AS average_rating,
              coalesce(score, 0) AS score
       FROM ideas LEFT JOIN totals USING (idea_id)""",
)
def _(t):
    return jobs.totals_for_ideas(t.ideas, t.votes)


@query(
    "vote_totals_large",
    TOTAL_COLUMNS,
    """SELECT *, upvote_count + downvote_count AS total_votes,
              CASE WHEN rating_count > 0 THEN rating_sum / rating_count ELSE 0 END AS average_rating,
              CASE WHEN upvote_count + downvote_count = 0 THEN 0
                   ELSE upvote_count - downvote_count + 2 * rating_sum END AS score
       FROM (SELECT idea_id, count(*) FILTER (WHERE vote_type = 'upvote') AS upvote_count,
                    count(*) FILTER (WHERE vote_type = 'downvote') AS downvote_count,
                    count(rating) AS rating_count, coalesce(sum(rating), 0) AS rating_sum
             FROM large_votes GROUP BY idea_id)""",
)
def _(t):
    return jobs.vote_totals(t.large_votes)


@query(
    "rating_sums",
    "idea_id:i upvotes:i downvotes:i ratings:i rating_sum:f",
    """SELECT idea_id, upvote_count AS upvotes, downvote_count AS downvotes, rating_count AS ratings, rating_sum
       FROM totals""",
)
def _(t):
    return jobs.rating_sums(t.votes)


@query(
    "idea_scores",
    "idea_id:i score:i",
    "SELECT idea_id, upvote_count - downvote_count AS score FROM totals",
)
def _(t):
    return jobs.idea_scores(t.votes)


@query(
    "daily_vote_trend",
    "window_start:t window_end:t total_votes:i upvotes:i downvotes:i",
    """SELECT date_trunc('day', created_at)::TIMESTAMP AS window_start,
              date_trunc('day', created_at)::TIMESTAMP + INTERVAL 1 DAY AS window_end, count(*) AS total_votes,
              count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes,
              count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes
       FROM votes GROUP BY ALL""",
)
def _(t):
    return jobs.daily_trend(t.votes)


HOURLY = """SELECT date_trunc('hour', created_at) AS window_start, count(*) AS votes_count FROM votes GROUP BY ALL"""


@query("hourly_vote_counts", "window_start:t votes_count:i", HOURLY)
def _(t):
    return jobs.hourly_counts(t.votes)


@query(
    "peak_voting_hours",
    "window_start:t votes_count:i",
    HOURLY + " ORDER BY votes_count DESC, window_start LIMIT 5",
)
def _(t):
    return jobs.peak_hours(t.votes)


VELOCITY = f"""SELECT idea_id, count(*) AS recent_votes, count(*) / 1440.0::DOUBLE AS votes_per_minute FROM votes
               WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS GROUP BY idea_id"""


@query("vote_velocity", "idea_id:i recent_votes:i votes_per_minute:f", VELOCITY)
def _(t):
    return jobs.vote_velocity(t.votes, AS_OF)


@query(
    "fastest_ideas",
    "idea_id:i recent_votes:i votes_per_minute:f",
    VELOCITY + " ORDER BY recent_votes DESC, idea_id LIMIT 10",
)
def _(t):
    return jobs.fastest_ideas(t.votes, AS_OF)


@query(
    "voting_stats",
    "total_votes_cast:i unique_voters:i",
    f"""SELECT count(*) AS total_votes_cast, count(DISTINCT user_id) AS unique_voters FROM votes
        WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS""",
)
def _(t):
    return jobs.voting_stats(t.votes, AS_OF, days=7)


@query(
    "most_voted_ideas",
    TOTAL_COLUMNS,
    "SELECT * FROM totals ORDER BY score DESC, idea_id LIMIT 10",
)
def _(t):
    return jobs.most_voted(t.votes)


@query(
    "recent_votes",
    "vote_id:i idea_id:i user_id:s vote_type:s created_at:t",
    "SELECT * FROM votes ORDER BY created_at DESC, vote_id DESC LIMIT 10",
)
def _(t):
    return jobs.recent_votes(t.votes)


@query(
    "duplicate_votes",
    "idea_id:i user_id:s vote_count:i",
    "SELECT idea_id, user_id, count(*) AS vote_count FROM votes GROUP BY ALL HAVING count(*) > 1",
)
def _(t):
    return jobs.duplicate_votes(t.votes)


LATEST = """SELECT * FROM votes
            QUALIFY row_number() OVER (PARTITION BY idea_id, user_id ORDER BY created_at DESC, vote_id DESC) = 1"""


@query("latest_votes", "idea_id:i user_id:s vote_id:i vote_type:s rating:f created_at:t", LATEST)
def _(t):
    return jobs.latest_votes(t.votes)


@query(
    "vote_history",
    "vote_id:i user_id:s idea_id:i vote_type:s previous_vote_type:s is_change:b",
    """SELECT *, coalesce(previous_vote_type <> vote_type, false) AS is_change FROM (
       SELECT *, lag(vote_type) OVER (PARTITION BY user_id, idea_id ORDER BY created_at, vote_id) AS previous_vote_type
       FROM votes)""",
)
def _(t):
    return jobs.vote_history(t.votes)


@query(
    "vote_status_of_user",
    "idea_id:i has_voted:b vote_type:s rating:f",
    f"""SELECT i.idea_id, v.vote_id IS NOT NULL AS has_voted, v.vote_type, v.rating
        FROM ideas i LEFT JOIN (SELECT * FROM ({LATEST}) WHERE user_id = '42') v USING (idea_id)""",
)
def _(t):
    return jobs.vote_status_of_users(t.ideas, t.votes, "42")


@query(
    "votes_on_published_ideas",
    "vote_id:i idea_id:i vote_type:s",
    "SELECT * FROM votes WHERE idea_id IN (SELECT idea_id FROM ideas WHERE status = 'published')",
)
def _(t):
    return jobs.votes_on(t.votes, t.ideas.where(F.col("status") == "published"))


@query(
    "expert_weighted_scores",
    "idea_id:i weighted_score:f weighted_votes:f expert_endorsements:i",
    """SELECT idea_id,
              sum(w * CASE vote_type WHEN 'upvote' THEN 1 WHEN 'downvote' THEN -1 ELSE 0 END) AS weighted_score,
              sum(w * CASE WHEN vote_type IN ('upvote', 'downvote') THEN 1 ELSE 0 END) AS weighted_votes,
              count(*) FILTER (WHERE vote_type = 'upvote' AND w > 1) AS expert_endorsements
       FROM (SELECT v.*, CASE WHEN e.user_id IS NULL THEN 1.0 ELSE 1.5 END AS w FROM votes v LEFT JOIN
             (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS user_id FROM supplier) e USING (user_id))
       GROUP BY idea_id""",
)
def _(t):
    experts = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("user_id"))
    return jobs.weighted_scores(t.votes, experts)


@query(
    "anonymous_votes",
    "vote_id:i idea_id:i user_id:s vote_type:s",
    f"SELECT vote_id, idea_id, sha256('{SALT}' || user_id) AS user_id, vote_type FROM votes",
)
def _(t):
    return jobs.anonymous(t.votes, SALT)


@query(
    "campaign_counts",
    "idea_id:i total_votes:i upvotes:i downvotes:i net_votes:i",
    """SELECT idea_id, count(*) AS total_votes, count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes,
              count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes,
              count(*) FILTER (WHERE vote_type = 'upvote') - count(*) FILTER (WHERE vote_type = 'downvote') AS net_votes
       FROM votes WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22' GROUP BY idea_id""",
)
def _(t):
    return jobs.campaign_counts(t.votes, "2024-01-08 00:00:00", "2024-01-22 00:00:00")


WINDOWS = """SELECT time_bucket(INTERVAL 5 MINUTES, created_at) AS window_start,
                    time_bucket(INTERVAL 5 MINUTES, created_at) + INTERVAL 5 MINUTES AS window_end, idea_id,
                    count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes,
                    count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes,
                    count(*) FILTER (WHERE vote_type = 'rating') AS ratings, avg(rating) AS avg_rating,
                    count(*) AS total_events,
                    count(*) FILTER (WHERE vote_type = 'upvote') - count(*) FILTER (WHERE vote_type = 'downvote') AS net_votes
             FROM votes GROUP BY ALL"""
WINDOW_COLUMNS = (
    "window_start:t window_end:t idea_id:i upvotes:i downvotes:i ratings:i avg_rating:f total_events:i net_votes:i"
)


@query("votes_per_window", WINDOW_COLUMNS, WINDOWS)
def _(t):
    return jobs.votes_per_window(t.vote_events)


@query(
    "trending_ideas",
    "idea_id:i window_end:t trending_score:f",
    f"""SELECT * FROM (SELECT *, (upvotes * 2 + ratings * 1.5 - downvotes)
               * exp(-0.1 * date_diff('second', window_end, TIMESTAMP '{AS_OF}') / 3600.0) AS trending_score
        FROM ({WINDOWS})) WHERE trending_score > 0""",
)
def _(t):
    return jobs.trending_ideas(jobs.votes_per_window(t.vote_events), AS_OF)


@query(
    "voting_anomalies",
    "window_start:t user_id:s vote_count:i unique_ideas:i unique_ips:i is_anomaly:b",
    """SELECT date_trunc('day', created_at)::TIMESTAMP AS window_start, user_id, count(*) AS vote_count,
              count(DISTINCT idea_id) AS unique_ideas, count(DISTINCT ip_address) AS unique_ips, true AS is_anomaly
       FROM votes GROUP BY ALL HAVING count(*) > 3 OR count(DISTINCT ip_address) > 5""",
)
def _(t):
    return jobs.voting_anomalies(t.vote_events, window="1 day", max_votes=3)


@query(
    "voting_anomalies_per_minute",
    "window_start:t user_id:s vote_count:i unique_ideas:i unique_ips:i",
    """SELECT date_trunc('minute', created_at) AS window_start, user_id, count(*) AS vote_count,
              count(DISTINCT idea_id) AS unique_ideas, count(DISTINCT ip_address) AS unique_ips
       FROM votes GROUP BY ALL HAVING count(*) > 20 OR count(DISTINCT ip_address) > 5""",
)
def _(t):
    return jobs.voting_anomalies(t.vote_events)


RULES = {
    "vote_surge": {"event": "vote", "key": "idea_id", "window": "1 day", "limit": 5, "severity": "Medium"},
    "comment_flood": {"event": "comment", "key": "idea_id", "window": "1 hour", "limit": 4, "severity": "Low"},
    "rapid_voter": {"event": "vote", "key": "user_id", "window": "1 day", "limit": 4, "severity": "High"},
}


ACTIVITY_COLUMNS = "anomaly_type:s severity:s subject:s window_start:t event_count:i"
ACTIVITY = """SELECT 'vote_surge' AS anomaly_type, 'Medium' AS severity, CAST(idea_id AS VARCHAR) AS subject,
              date_trunc('day', created_at)::TIMESTAMP AS window_start, count(*) AS event_count
       FROM votes GROUP BY ALL HAVING count(*) >= 5
       UNION ALL
       SELECT 'comment_flood', 'Low', CAST(idea_id AS VARCHAR), date_trunc('hour', created_at), count(*)
       FROM comments GROUP BY ALL HAVING count(*) >= 4
       UNION ALL
       SELECT 'rapid_voter', 'High', user_id, date_trunc('day', created_at)::TIMESTAMP, count(*)
       FROM votes GROUP BY ALL HAVING count(*) >= 4"""


@query("activity_anomalies", ACTIVITY_COLUMNS, ACTIVITY)
def _(t):
    return jobs.activity_anomalies({"vote": t.votes, "comment": t.comments}, RULES)


@query(
    "votes_over_limit",
    "window_start:t user_id:s vote_count:i excess_votes:i",
    """SELECT time_bucket(INTERVAL 6 HOURS, created_at) AS window_start, user_id, count(*) AS vote_count,
              count(*) - 1 AS excess_votes FROM votes GROUP BY ALL HAVING count(*) > 1""",
)
def _(t):
    return jobs.votes_over_limit(t.votes, limit=1, window="6 hours")


@query(
    "current_votes_after_changes",
    "idea_id:i total_votes:i upvotes:i downvotes:i",
    """SELECT idea_id, count(*) AS total_votes, count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes,
              count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes
       FROM (SELECT * FROM vote_events
             QUALIFY row_number() OVER (PARTITION BY idea_id, user_id ORDER BY "timestamp" DESC, event_id DESC) = 1)
       WHERE event_type <> 'vote_removed' GROUP BY idea_id""",
)
def _(t):
    return jobs.net_from_lifecycle(t.vote_events)


@query(
    "participation",
    "total_users:i total_votes:i voters:i avg_votes_per_idea:f participation_rate:f",
    """SELECT u.n AS total_users, v.votes AS total_votes, v.voters, v.votes / i.n::DOUBLE AS avg_votes_per_idea,
              v.voters / u.n::DOUBLE AS participation_rate
       FROM (SELECT count(*) AS votes, count(DISTINCT user_id) AS voters FROM votes) v,
            (SELECT count(*) AS n FROM ideas) i, (SELECT count(DISTINCT user_id) AS n FROM events) u""",
)
def _(t):
    return jobs.participation(t.ideas, t.votes, t.users)


@query(
    "experiment_results",
    "variant:s exposures:i conversions:i conversion_rate:f lift:f z_score:f confident:b",
    """WITH r AS (SELECT 'variant ' || (user_id % 3) AS variant, count(*) AS exposures,
                         count(*) FILTER (WHERE event_type = 'purchase') AS conversions
                  FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL),
            c AS (SELECT exposures AS n, conversions AS h FROM r WHERE variant = 'variant 0'),
            s AS (SELECT r.*, c.n, c.h, conversions / exposures::DOUBLE AS conversion_rate,
                         (conversions + h) / (exposures + n)::DOUBLE AS pooled FROM r, c),
            z AS (SELECT *, conversion_rate / (h / n::DOUBLE) - 1 AS lift,
                         (conversion_rate - h / n::DOUBLE) / sqrt(pooled * (1 - pooled) * (1.0 / exposures + 1.0 / n)) AS z_score
                  FROM s)
       SELECT variant, exposures, conversions, conversion_rate, lift, z_score, abs(z_score) >= 1.959964 AS confident
       FROM z""",
)
def _(t):
    results = jobs.variant_results(
        t.events,
        exposed=F.col("event_type").isin("view", "purchase"),
        converted=F.col("event_type") == "purchase",
        variant=F.concat(F.lit("variant "), (F.col("user_id") % 3).cast("string")),
    )
    return jobs.compare_variants(results, "variant 0").withColumn("confident", F.col("confidence") >= 0.95)


@query(
    "category_leaderboard",
    "category:s rank:i idea_id:i score:f total_votes:i",
    """SELECT category, row_number() OVER (PARTITION BY category ORDER BY coalesce(score, 0) DESC,
              coalesce(total_votes, 0) DESC, idea_id) AS rank, idea_id, coalesce(score, 0) AS score,
              coalesce(total_votes, 0) AS total_votes
       FROM ideas LEFT JOIN totals USING (idea_id) QUALIFY rank <= 3""",
)
def _(t):
    return jobs.leaderboard(t.ideas, t.votes)


@query(
    "vote_timestamps",
    "vote_id:i vote_timestamp:t hour_of_day:f idea_batch_score:f",
    """SELECT vote_id, created_at AS vote_timestamp,
              (epoch(created_at)::BIGINT % 86400 - 0) / 3600.0 AS hour_of_day, idea_id / 100.0 AS idea_batch_score
       FROM (SELECT vote_id, idea_id, date_trunc('second', created_at) AS created_at FROM votes)""",
)
def _(t):
    return t.votes.select(
        "vote_id",
        F.to_timestamp("created_at").alias("vote_timestamp"),
        timeparts.hour_fraction("created_at").alias("hour_of_day"),
        scores.volume_score("idea_id", 100.0).alias("idea_batch_score"),
    )


@query(
    "vote_activity_trend",
    "vote_type:s points:i recent_average:f historical_average:f growth_rate:f trend:s",
    """SELECT *, CASE WHEN growth_rate > 0.1 THEN 'rising' WHEN growth_rate < -0.1 THEN 'declining' ELSE 'stable' END AS trend
       FROM (SELECT vote_type, points, recent / least(points, 7) AS recent_average,
                    older / greatest(points - 7, 1) AS historical_average,
                    CASE WHEN older = 0 THEN 1.0 ELSE
                    (recent / least(points, 7) - older / greatest(points - 7, 1)) / (older / greatest(points - 7, 1)) END AS growth_rate
             FROM (SELECT vote_type, count(*) AS points, coalesce(sum(n) FILTER (WHERE pos <= 7), 0)::DOUBLE AS recent,
                          coalesce(sum(n) FILTER (WHERE pos > 7), 0)::DOUBLE AS older
                   FROM (SELECT *, row_number() OVER (PARTITION BY vote_type ORDER BY day DESC) AS pos
                         FROM (SELECT vote_type, date_trunc('day', created_at) AS day, count(*) AS n FROM votes GROUP BY ALL))
                   GROUP BY vote_type))""",
)
def _(t):
    from agora.operators.ideas import series_trend

    daily = t.votes.groupBy("vote_type", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return series_trend(daily, ["vote_type"], "day", "n")


@query(
    "vote_rule_errors",
    "vote_id:i field:s error_type:s",
    """SELECT vote_id, 'idea_id' AS field, 'range' AS error_type FROM votes WHERE idea_id <= 0""",
)
def _(t):
    from agora.operators import quality

    _, bad = quality.split_valid(t.votes, quality.vote_rules())
    return bad


@query(
    "voter_label",
    "vote_id:i label:s",
    "SELECT vote_id, user_id || ' (Unknown)' AS label FROM votes",
)
def _(t):
    none = F.lit(None).cast("string")
    return t.votes.select("vote_id", text.label(none, F.col("user_id"), none).alias("label"))
