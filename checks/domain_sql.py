"""The domain tables as DuckDB SQL over the given tables, mirroring ``GivenTables``."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

_CREATED = (
    "TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INTEGER))"
    " + to_hours(CAST(doc_id % 24 AS INTEGER)) + to_minutes(CAST(doc_id % 60 AS INTEGER))"
)

TABLES: dict[str, str] = {
    "votes": """
        SELECT event_id AS vote_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS idea_id,
               CAST(user_id AS VARCHAR) AS user_id,
               CASE event_type WHEN 'click' THEN 'upvote' WHEN 'error' THEN 'downvote' ELSE 'rating' END AS vote_type,
               CASE WHEN event_type = 'purchase' THEN CAST(1.0 + (event_id % 9) * 0.5 AS DOUBLE) END AS rating,
               '10.0.' || (event_id % 7) || '.1' AS ip_address, ts AS created_at
        FROM events WHERE event_type IN ('click', 'error', 'purchase')""",
    "vote_events": """
        SELECT CAST(vote_id AS VARCHAR) AS event_id,
               CASE vote_id % 11 WHEN 0 THEN 'vote_removed' WHEN 1 THEN 'vote_updated' ELSE 'vote_cast' END AS event_type,
               idea_id, user_id, vote_type, rating, created_at AS "timestamp", ip_address
        FROM votes""",
    "large_votes": """
        SELECT l_orderkey * 8 + l_linenumber AS vote_id, CAST(l_partkey AS INTEGER) AS idea_id,
               CAST(l_suppkey AS VARCHAR) AS user_id,
               CASE l_returnflag WHEN 'A' THEN 'upvote' WHEN 'R' THEN 'downvote' WHEN 'N' THEN 'rating' END AS vote_type,
               CASE WHEN l_returnflag = 'N' THEN 1.0 + (l_quantity % 9) * 0.5 END AS rating,
               l_shipdate AS created_at
        FROM lineitem""",
    "ideas": f"""
        SELECT CAST(doc_id AS INTEGER) AS idea_id, split_part(text, chr(10), 1) AS title, text AS description,
               CASE lang WHEN 'en' THEN 'innovation' WHEN 'fr' THEN 'improvement' WHEN 'de' THEN 'cost_saving'
                    ELSE 'other' END AS category,
               CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'published' WHEN 2 THEN 'under_review'
                    WHEN 3 THEN 'implemented' ELSE 'rejected' END AS status,
               CAST(doc_id % 160 AS VARCHAR) AS user_id, 'user_' || (doc_id % 160) AS user_name,
               n_chars AS view_count, lang, source, {_CREATED} AS created_at
        FROM documents""",
    "totals": """
        SELECT idea_id, count(*) FILTER (WHERE vote_type = 'upvote') AS upvote_count,
               count(*) FILTER (WHERE vote_type = 'downvote') AS downvote_count,
               count(*) FILTER (WHERE vote_type = 'rating' AND rating <> 0) AS rating_count,
               coalesce(sum(rating) FILTER (WHERE vote_type = 'rating' AND rating <> 0), 0) AS rating_sum,
               count(*) FILTER (WHERE vote_type IN ('upvote', 'downvote')) AS total_votes,
               coalesce(avg(rating) FILTER (WHERE vote_type = 'rating' AND rating <> 0), 0) AS average_rating,
               CASE WHEN count(*) FILTER (WHERE vote_type IN ('upvote', 'downvote')) = 0 THEN 0
                    ELSE count(*) FILTER (WHERE vote_type = 'upvote') - count(*) FILTER (WHERE vote_type = 'downvote')
                         + 2 * coalesce(sum(rating) FILTER (WHERE vote_type = 'rating' AND rating <> 0), 0) END AS score
        FROM votes GROUP BY idea_id""",
    "rated_ideas": """
        SELECT i.*, coalesce(t.total_votes, 0) AS vote_count, coalesce(t.average_rating, 0) AS average_rating
        FROM ideas i LEFT JOIN totals t USING (idea_id)""",
    "comments": """
        SELECT conv_id * 1000 + turn AS comment_id, CAST(conv_id AS INTEGER) AS idea_id,
               CAST(turn % 15 AS VARCHAR) AS user_id, text AS content, (conv_id + turn) % 7 = 0 AS is_deleted,
               TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 30 AS INTEGER))
               + to_minutes(CAST(turn AS INTEGER)) AS created_at
        FROM conversations""",
    "active_comments": "SELECT * FROM comments WHERE NOT is_deleted",
    "vote_metrics": """
        SELECT idea_id, count(*) FILTER (WHERE vote_type = 'upvote') AS upvote_count,
               count(*) FILTER (WHERE vote_type = 'downvote') AS downvote_count,
               count(*) FILTER (WHERE vote_type = 'rating') AS rating_count,
               avg(rating) FILTER (WHERE vote_type = 'rating') AS avg_rating,
               stddev_samp(rating) FILTER (WHERE vote_type = 'rating') AS rating_stddev,
               count(*) AS total_votes, count(DISTINCT user_id) AS unique_voters
        FROM votes GROUP BY idea_id""",
    "comment_metrics": """
        SELECT idea_id, count(*) AS comment_count, count(DISTINCT user_id) AS unique_commenters
        FROM active_comments GROUP BY idea_id""",
    "idea_metrics": f"""
        SELECT i.*, date_diff('day', CAST(i.created_at AS DATE), CAST({AS_OF} AS DATE)) AS days_since_created,
               date_diff('day', CAST(i.created_at AS DATE), CAST({AS_OF} AS DATE)) <= 7 AS is_recent,
               coalesce(upvote_count, 0) AS upvote_count, coalesce(downvote_count, 0) AS downvote_count,
               coalesce(rating_count, 0) AS rating_count, coalesce(avg_rating, 0) AS avg_rating,
               coalesce(rating_stddev, 0) AS rating_stddev, coalesce(total_votes, 0) AS total_votes,
               coalesce(unique_voters, 0) AS unique_voters, coalesce(comment_count, 0) AS comment_count,
               coalesce(unique_commenters, 0) AS unique_commenters,
               coalesce(upvote_count * 2 + rating_count * 1.5 - downvote_count, 0) AS engagement_score,
               CASE WHEN coalesce(unique_voters, 0) > 0
                    THEN coalesce(comment_count, 0) / CAST(unique_voters AS DOUBLE) ELSE 0 END AS discussion_rate,
               CASE WHEN coalesce(total_votes, 0) > 10
                    THEN downvote_count / CAST(total_votes AS DOUBLE) * coalesce(rating_stddev, 0) ELSE 0 END
                    AS controversy_score
        FROM rated_ideas i LEFT JOIN vote_metrics USING (idea_id) LEFT JOIN comment_metrics USING (idea_id)""",
    "performance": """
        SELECT i.*, coalesce(v.total_votes, 0) AS total_votes, coalesce(v.upvotes, 0) AS upvotes,
               coalesce(v.downvotes, 0) AS downvotes, coalesce(c.comment_count, 0) AS comment_count,
               CASE WHEN v.total_votes > 0 THEN v.upvotes / CAST(v.total_votes AS DOUBLE) ELSE 0 END AS upvote_ratio,
               coalesce(v.upvotes, 0) - coalesce(v.downvotes, 0) AS net_score,
               coalesce(v.total_votes, 0) + 2 * coalesce(c.comment_count, 0) AS engagement_score
        FROM ideas i
        LEFT JOIN (SELECT idea_id, count(*) AS total_votes, count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes,
                          count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes
                   FROM votes GROUP BY idea_id) v USING (idea_id)
        LEFT JOIN comment_metrics c USING (idea_id)""",
    "user_analytics": """
        SELECT user_id, coalesce(ideas_created, 0) AS ideas_created, coalesce(ideas_published, 0) AS ideas_published,
               coalesce(ideas_implemented, 0) AS ideas_implemented, coalesce(avg_votes_per_idea, 0) AS avg_votes_per_idea,
               coalesce(total_votes_cast, 0) AS total_votes_cast, coalesce(upvotes_given, 0) AS upvotes_given,
               coalesce(downvotes_given, 0) AS downvotes_given, coalesce(ratings_given, 0) AS ratings_given,
               coalesce(avg_rating_given, 0) AS avg_rating_given,
               CASE WHEN downvotes_given > 0 THEN upvotes_given / CAST(downvotes_given AS DOUBLE)
                    ELSE coalesce(upvotes_given, 0) END AS positivity_ratio,
               coalesce(comments_made, 0) AS comments_made,
               coalesce(unique_ideas_commented, 0) AS unique_ideas_commented,
               CASE WHEN coalesce(ideas_created, 0) + coalesce(total_votes_cast, 0) + coalesce(comments_made, 0) > 50 THEN 'high'
                    WHEN coalesce(ideas_created, 0) + coalesce(total_votes_cast, 0) + coalesce(comments_made, 0) > 10 THEN 'medium'
                    ELSE 'low' END AS engagement_level,
               coalesce(ideas_created, 0) * 10 + coalesce(ideas_implemented, 0) * 50
               + coalesce(total_votes_cast, 0) + coalesce(comments_made, 0) * 2 AS user_score
        FROM (SELECT user_id, count(*) AS ideas_created, count(*) FILTER (WHERE status = 'published') AS ideas_published,
                     count(*) FILTER (WHERE status = 'implemented') AS ideas_implemented, avg(vote_count) AS avg_votes_per_idea
              FROM rated_ideas GROUP BY user_id)
        FULL JOIN (SELECT user_id, count(*) AS total_votes_cast,
                          count(*) FILTER (WHERE vote_type = 'upvote') AS upvotes_given,
                          count(*) FILTER (WHERE vote_type = 'downvote') AS downvotes_given,
                          count(*) FILTER (WHERE vote_type = 'rating') AS ratings_given,
                          avg(rating) FILTER (WHERE vote_type = 'rating') AS avg_rating_given
                   FROM votes GROUP BY user_id) USING (user_id)
        FULL JOIN (SELECT user_id, count(*) AS comments_made, count(DISTINCT idea_id) AS unique_ideas_commented
                   FROM active_comments GROUP BY user_id) USING (user_id)""",
    "interactions": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, ts AS "timestamp",
               CASE event_type WHEN 'view' THEN ' View' WHEN 'click' THEN 'Like ' WHEN 'signup' THEN 'CREATE'
                    WHEN 'purchase' THEN 'share' ELSE 'delete' END AS interaction_type,
               json_extract_string(props, '$.k') AS content_id, ts AS session_start,
               ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS session_end, value AS engagement_score
        FROM events""",
    "metrics": """
        SELECT event_id, event_type AS metric_name, value AS metric_value, 'svc' || (user_id % 5) AS component,
               ts AS "timestamp"
        FROM events""",
    "system_metrics": """
        SELECT event_id,
               CASE event_type WHEN 'view' THEN 'throughput' WHEN 'click' THEN 'cpu_usage' WHEN 'signup' THEN 'memory_usage'
                    WHEN 'purchase' THEN 'response_time' ELSE 'error_rate' END AS metric_name,
               value * CASE WHEN event_type = 'purchase' THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END AS metric_value,
               'svc' || (user_id % 5) AS component, ts AS "timestamp"
        FROM events""",
    "thoughts": f"""
        SELECT doc_id AS thought_id, CAST(doc_id % 160 AS VARCHAR) AS user_id, text AS thought_text,
               CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 25 - 12) / 10.0::DOUBLE END AS sentiment_score,
               lang, source, {_CREATED} AS "timestamp"
        FROM documents""",
    "recommendations": """
        SELECT CAST(user_id AS VARCHAR) AS user_id, 'algo_' || (user_id % 4) AS algorithm,
               (event_id % 120) / 100.0::DOUBLE AS confidence_score, event_id % 60 AS content_count,
               json_extract_string(props, '$.k') AS content_id,
               CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS DOUBLE) END AS feedback_score, ts AS "timestamp", event_id
        FROM events WHERE event_type = 'view'""",
    "decisions": """
        SELECT *, CASE WHEN status = 'implemented' THEN decided_at + to_days(CAST(id % 60 + 5 AS INTEGER)) END AS implemented_at
        FROM (SELECT o_orderkey AS id, 'd' || o_orderkey AS decision_id, CAST(o_orderkey % 200 AS INTEGER) AS idea_id,
                     CASE o_orderpriority WHEN '1-URGENT' THEN 'implementation' WHEN '2-HIGH' THEN 'escalation'
                          WHEN '3-MEDIUM' THEN 'modification' WHEN '4-NOT SPECIFIED' THEN 'deferral'
                          ELSE 'rejection' END AS decision_type,
                     CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'approved' ELSE 'implemented' END AS status,
                     CAST(o_custkey AS VARCHAR) AS decided_by, 'Decision on idea ' || (o_orderkey % 200) AS summary,
                     'priority ' || o_orderpriority AS rationale, o_orderkey % 120 AS timeline_days,
                     o_totalprice AS estimated_cost, o_totalprice * (o_custkey % 7) / 3.0::DOUBLE AS estimated_revenue,
                     o_orderkey % 5 AS risk_count, (o_custkey % 100) / 100.0::DOUBLE AS success_probability,
                     o_orderdate AS created_at,
                     CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(CAST(o_orderkey % 40 + 1 AS INTEGER)) END AS decided_at
              FROM orders)""",
    "decision_events": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS event_id,
               l_orderkey AS decision_id,
               CASE l_linenumber WHEN 1 THEN 'decision_created' WHEN 2 THEN 'status_changed'
                    WHEN 3 THEN 'metrics_snapshot_taken' WHEN 4 THEN 'committee_assigned'
                    WHEN 5 THEN 'implementation_plan_updated' WHEN 6 THEN 'status_changed'
                    ELSE 'conditions_updated' END AS event_type,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'approved' WHEN 'AO' THEN 'in_review'
                    WHEN 'RF' THEN 'rejected' WHEN 'RO' THEN 'pending' WHEN 'NF' THEN 'implemented'
                    ELSE 'on_hold' END AS new_status,
               l_partkey, l_suppkey, l_returnflag, CAST(l_suppkey AS VARCHAR) AS actor_id,
               CASE WHEN l_suppkey % 3 <> 0 THEN 'Actor ' || l_suppkey END AS actor_name,
               CASE WHEN l_suppkey % 2 = 0 THEN 'approver' END AS actor_role, l_shipdate AS occurred_at,
               l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS sequence
        FROM lineitem""",
    "committee_votes": """
        SELECT l_orderkey AS decision_id, CAST(l_suppkey AS VARCHAR) AS member_id,
               CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' WHEN 'N' THEN 'modify' END AS vote,
               CASE WHEN l_linenumber = 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM lineitem""",
    "criteria": """
        SELECT n_nationkey AS criteria_id, 'rule ' || n_name AS name, n_nationkey * 3 AS min_vote_count,
               n_nationkey * 4.0 AS min_engagement_score, 1.0 + (n_nationkey % 9) * 0.5 AS min_average_rating,
               (n_nationkey % 10) / 10.0::DOUBLE AS max_controversy_score, n_nationkey % 5 AS min_days_since_created,
               (n_nationkey % 7) / 10.0::DOUBLE AS min_success_probability,
               CASE n_nationkey % 4 WHEN 0 THEN 'implementation' WHEN 1 THEN 'modification' WHEN 2 THEN 'escalation'
                    ELSE 'rejection' END AS suggested_decision_type,
               n_nationkey % 2 = 0 AS auto_approve, n_nationkey % 6 <> 5 AS is_active
        FROM nation""",
    "templates": """
        SELECT r_name AS template,
               CASE r_regionkey WHEN 0 THEN 'implementation' WHEN 1 THEN 'escalation' WHEN 2 THEN 'modification'
                    WHEN 3 THEN 'deferral' ELSE 'rejection' END AS decision_type,
               'Template ' || r_name AS summary_template, 'Standard rationale ' || r_name AS rationale_template,
               r_regionkey * 10 + 30 AS default_timeline_days
        FROM region""",
    "suggestions": """
        SELECT idea_id, coalesce(best.suggested_decision_type, 'deferral') AS suggested_decision_type,
               coalesce(best.tenths / 10.0::DOUBLE, 0.3) AS confidence_score, coalesce(best.names, '') AS matching_criteria,
               coalesce(best.auto_approve AND best.tenths > 8, false) AS auto_approve_eligible,
               coalesce(best.tenths, 3) < 8 AS needs_review
        FROM (SELECT DISTINCT idea_id FROM success_metrics) LEFT JOIN
             (SELECT idea_id, arg_max(suggested_decision_type, tenths * 1000 - criteria_id) AS suggested_decision_type,
                     max(tenths) AS tenths, arg_max(auto_approve, tenths * 1000 - criteria_id) AS auto_approve,
                     string_agg(name, '|' ORDER BY criteria_id) AS names
              FROM (SELECT m.idea_id, c.*,
                           2 * (vote_count >= min_vote_count)::INT + 2 * (engagement_score >= min_engagement_score)::INT
                           + 2 * (average_rating >= min_average_rating)::INT
                           + (controversy_score <= max_controversy_score)::INT
                           + 3 * (success_probability >= min_success_probability)::INT AS tenths,
                           (vote_count >= min_vote_count)::INT + (engagement_score >= min_engagement_score)::INT
                           + (average_rating >= min_average_rating)::INT + (controversy_score <= max_controversy_score)::INT
                           + (success_probability >= min_success_probability)::INT AS hits
                    FROM success_metrics m, criteria c WHERE c.is_active)
              WHERE hits >= 3 GROUP BY idea_id) best USING (idea_id)""",
    "success_metrics": """
        SELECT idea_id, total_votes AS vote_count, engagement_score, avg_rating AS average_rating, controversy_score,
               (idea_id % 100) / 100.0::DOUBLE AS success_probability, status, days_since_created
        FROM idea_metrics""",
}


def with_tables(body: str) -> str:
    """Put the domain tables a query uses, and those they use, in front of it."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s+\w+\s", sql):
                needed.add(name)
                visit(TABLES[name])

    visit(body)
    if not needed:
        return body
    ordered: list[str] = []

    def place(name: str) -> None:
        for other in needed:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b|,\s*{other}\s+\w+\s", TABLES[name]):
                if other not in ordered:
                    place(other)
        if name not in ordered:
            ordered.append(name)

    for name in TABLES:
        if name in needed:
            place(name)
    ctes = ",\n".join(f"{n} AS ({TABLES[n]})" for n in ordered)
    return f"WITH {ctes}\n{body}"
