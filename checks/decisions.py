"""Decision, event-log and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.functions import scores, timeparts
from agora.operators import decisions as jobs
from agora.operators import ideas as idea_jobs
from agora.operators import rules
from agora.sources.adapter import AS_OF
from checks.registry import query

DAY = "1998-10-10 00:00:00"


@query(
    "decision_search",
    "id:i idea_id:i status:s decision_type:s created_at:t",
    f"""SELECT * FROM decisions WHERE status = 'approved' AND decision_type = 'escalation'
        AND created_at >= TIMESTAMP '{DAY}' - INTERVAL 300 DAYS""",
)
def _(t):
    return jobs.search_decisions(t.decisions, DAY, status="approved", decision_type="escalation", days_back=300)


@query(
    "decision_listing",
    "id:i status:s events_count:i",
    f"""SELECT id, status, coalesce(n, 0) AS events_count
        FROM (SELECT * FROM decisions WHERE created_at >= TIMESTAMP '{DAY}' - INTERVAL 30 DAYS
              ORDER BY created_at DESC, id LIMIT 50)
        LEFT JOIN (SELECT decision_id AS id, count(*) AS n FROM decision_events GROUP BY ALL) USING (id)""",
)
def _(t):
    return jobs.list_decisions(jobs.search_decisions(t.decisions, DAY), t.decision_events)


@query(
    "decisions_with_event_count",
    "id:i events_count:i",
    """SELECT id, coalesce(n, 0) AS events_count FROM decisions
       LEFT JOIN (SELECT decision_id AS id, count(*) AS n FROM decision_events GROUP BY ALL) USING (id)""",
)
def _(t):
    return jobs.with_event_count(t.decisions, t.decision_events)


@query(
    "decisions_with_events",
    "id:i idea_id:i status:s event_id:s event_type:s actor_id:s occurred_at:t",
    """SELECT d.id, d.idea_id, d.status, e.event_id, e.event_type, e.actor_id, e.occurred_at
       FROM decisions d LEFT JOIN decision_events e ON e.decision_id = d.id""",
)
def _(t):
    return jobs.decision_with_events(t.decisions, t.decision_events)


@query(
    "recent_decisions",
    "id:i created_at:t status:s",
    "SELECT * FROM decisions ORDER BY created_at DESC, id LIMIT 10",
)
def _(t):
    return jobs.recent_decisions(t.decisions)


@query(
    "decision_counts",
    "dimension:s value:s decision_count:i",
    """SELECT 'status' AS dimension, status AS value, count(*) AS decision_count FROM decisions GROUP BY ALL
       UNION ALL SELECT 'type', decision_type, count(*) FROM decisions GROUP BY ALL""",
)
def _(t):
    return jobs.decision_counts(t.decisions)


@query(
    "decision_times",
    "total_decisions:i average_time_to_decision:f average_implementation_time:f",
    """SELECT count(*) AS total_decisions, avg(date_diff('day', created_at, decided_at)) AS average_time_to_decision,
              avg(date_diff('day', decided_at, implemented_at)) AS average_implementation_time FROM decisions""",
)
def _(t):
    return jobs.decision_times(t.decisions)


@query(
    "decision_durations",
    "id:i days_to_decision:f processing_seconds:i",
    """SELECT id, date_diff('day', created_at, decided_at) AS days_to_decision,
              date_diff('second', decided_at, implemented_at) AS processing_seconds FROM decisions""",
)
def _(t):
    return t.decisions.select(
        "id",
        timeparts.days_between("created_at", "decided_at").alias("days_to_decision"),
        timeparts.whole_seconds_between("decided_at", "implemented_at").alias("processing_seconds"),
    )


@query(
    "decision_impact",
    "id:i roi_estimate:f adjusted_success_probability:f expected_value:f risk_level:s",
    """SELECT id, (estimated_revenue - estimated_cost) / estimated_cost AS roi_estimate,
              greatest(success_probability - risk_count * 0.05, 0.1) AS adjusted_success_probability,
              (estimated_revenue - estimated_cost) * greatest(success_probability - risk_count * 0.05, 0.1) AS expected_value,
              CASE WHEN risk_count > 2 THEN 'high' WHEN risk_count > 0 THEN 'medium' ELSE 'low' END AS risk_level
       FROM decisions""",
)
def _(t):
    return jobs.with_impact(t.decisions)


@query(
    "success_likelihood",
    "id:i success_likelihood:s",
    """SELECT id, CASE WHEN success_probability > 0.7 THEN 'High' WHEN success_probability > 0.4 THEN 'Medium' ELSE 'Low' END
              AS success_likelihood FROM decisions""",
)
def _(t):
    return t.decisions.select("id", scores.success_likelihood("success_probability").alias("success_likelihood"))


@query(
    "roi_by_category",
    "category:s ideas_implemented:i total_investment:m measured_benefits:m roi:f success_rate:f avg_implementation_days:f",
    """SELECT category, count(*) FILTER (WHERE d.status = 'implemented') AS ideas_implemented,
              sum(estimated_cost) FILTER (WHERE d.status = 'implemented') AS total_investment,
              sum(estimated_revenue) FILTER (WHERE d.status = 'implemented') AS measured_benefits,
              sum(estimated_revenue) FILTER (WHERE d.status = 'implemented')
              / sum(estimated_cost) FILTER (WHERE d.status = 'implemented') - 1 AS roi,
              count(*) FILTER (WHERE d.status = 'implemented') / count(*)::DOUBLE AS success_rate,
              avg(date_diff('day', decided_at, implemented_at)) AS avg_implementation_days
       FROM decisions d JOIN ideas USING (idea_id) GROUP BY category""",
)
def _(t):
    return jobs.roi_by_category(t.decisions, t.ideas)


@query(
    "decision_timeline",
    "decision_id:i timestamp:t event_type:s actor_id:s actor_name:s actor_role:s",
    'SELECT *, occurred_at AS "timestamp" FROM decision_events',
)
def _(t):
    return jobs.timeline(t.decision_events).select(
        "decision_id",
        "timestamp",
        "event_type",
        F.col("actor.id").alias("actor_id"),
        F.col("actor.name").alias("actor_name"),
        F.col("actor.role").alias("actor_role"),
    )


@query(
    "decision_history",
    "decision_id:i event_id:s event_type:s occurred_at:t",
    "SELECT * FROM decision_events",
)
def _(t):
    return jobs.decision_history(t.decision_events)


@query(
    "audit_trail",
    "event_id:s event_type:s actor:s timestamp:t",
    """SELECT event_id, event_type, coalesce(actor_name, actor_id) || ' (' || coalesce(actor_role, 'Unknown') || ')' AS actor,
              occurred_at AS "timestamp"
       FROM decision_events WHERE event_type IN ('status_changed', 'committee_assigned')""",
)
def _(t):
    return jobs.audit_trail(t.decision_events, ["status_changed", "committee_assigned"])


def _newest(value: str, condition: str) -> str:
    return f"arg_max({value}, (occurred_at, sequence)) FILTER (WHERE {condition})"


@query(
    "replayed_decisions",
    "decision_id:i status:s decided_at:t decided_by:s implemented_at:t metrics_snapshot:s implementation_plan:s"
    " decision_committee:s conditions:s event_count:i",
    f"""SELECT decision_id,
               {_newest('new_status', "event_type = 'status_changed'")} AS status,
               {_newest('occurred_at', "event_type = 'status_changed' AND new_status = 'approved'")} AS decided_at,
               {_newest('actor_id', "event_type = 'status_changed' AND new_status = 'approved'")} AS decided_by,
               {_newest('occurred_at', "event_type = 'status_changed' AND new_status = 'implemented'")} AS implemented_at,
               {_newest("'{{' || chr(34) || 'views' || chr(34) || ':' || l_partkey || '}}'", "event_type = 'metrics_snapshot_taken'")} AS metrics_snapshot,
               {_newest("'plan ' || l_partkey", "event_type = 'implementation_plan_updated'")} AS implementation_plan,
               {_newest("'[' || chr(34) || l_suppkey || chr(34) || ',' || chr(34) || l_partkey || chr(34) || ']'", "event_type = 'committee_assigned'")} AS decision_committee,
               {_newest("'[' || chr(34) || 'c' || l_returnflag || chr(34) || ']'", "event_type = 'conditions_updated'")} AS conditions,
               count(*) AS event_count
        FROM decision_events GROUP BY decision_id""".replace("{{", "{").replace("}}", "}"),
)
def _(t):
    return jobs.replay(t.decision_events)


@query(
    "status_moves",
    "event_id:s decision_id:i old_status:s new_status:s is_valid:b",
    """SELECT *, CASE new_status WHEN 'approved' THEN old_status = 'pending'
                      WHEN 'rejected' THEN old_status IN ('pending', 'in_review') ELSE true END AS is_valid
       FROM (SELECT event_id, decision_id, new_status,
                    coalesce(lag(new_status) OVER (PARTITION BY decision_id ORDER BY occurred_at, sequence), 'pending') AS old_status
             FROM decision_events WHERE event_type = 'status_changed')""",
)
def _(t):
    return jobs.status_moves(t.decision_events)


@query(
    "actor_activity",
    "actor_id:s total_actions:i actions:s decisions_affected:i",
    """SELECT actor_id, sum(n) AS total_actions, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS actions,
              any_value(d) AS decisions_affected
       FROM (SELECT actor_id, event_type, count(*) AS n FROM decision_events
             WHERE occurred_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY ALL)
       JOIN (SELECT actor_id, count(DISTINCT decision_id) AS d FROM decision_events
             WHERE occurred_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY ALL) USING (actor_id)
       GROUP BY actor_id""",
)
def _(t):
    pairs = F.transform(
        F.map_entries("actions_by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return jobs.actor_activity(t.decision_events, "1996-01-01 00:00:00", "1999-12-31 00:00:00").withColumn(
        "actions", F.array_join(pairs, ",")
    )


@query(
    "actor_decisions",
    "actor_id:s decision_id:i",
    "SELECT DISTINCT actor_id, decision_id FROM decision_events",
)
def _(t):
    return jobs.actor_decisions(t.decision_events)


@query(
    "actor_recent_actions",
    "actor_id:s position:i timestamp:t event_type:s decision_id:i",
    """SELECT *, occurred_at AS "timestamp",
              row_number() OVER (PARTITION BY actor_id ORDER BY occurred_at DESC, sequence DESC, decision_id) AS position
       FROM decision_events QUALIFY position <= 10""",
)
def _(t):
    return jobs.actor_recent_actions(t.decision_events)


def _committee(weight: str) -> str:
    return f"""
        SELECT decision_id, arg_min(vote, (-w, vote)) AS final_decision, max(w) / sum(w) * 100 AS consensus_share,
               count(*) = 1 AS unanimous,
               CASE WHEN count(*) = 1 THEN 'unanimous' WHEN count(*) = 2 AND sum(n) > 2 THEN 'majority' ELSE 'split' END AS consensus_level,
               CASE WHEN arg_min(vote, (-w, vote)) = 'approve' THEN 'approved' ELSE 'in_review' END AS status
        FROM (SELECT decision_id, vote, sum({weight}) AS w, count(*) AS n FROM committee_votes GROUP BY ALL)
        GROUP BY decision_id"""


COMMITTEE = "decision_id:i final_decision:s consensus_share:f unanimous:b consensus_level:s status:s"


@query("committee_results", COMMITTEE, _committee("weight"))
def _(t):
    return jobs.committee_results(t.committee_votes)


@query("committee_results_unweighted", COMMITTEE, _committee("1.0::DOUBLE"))
def _(t):
    return jobs.committee_results(t.committee_votes, weighted=False)


@query(
    "committee_shares",
    "decision_id:i vote:s option_weight:f percentage:f",
    """SELECT *, option_weight / sum(option_weight) OVER (PARTITION BY decision_id) * 100 AS percentage
       FROM (SELECT decision_id, vote, sum(weight) AS option_weight FROM committee_votes GROUP BY ALL)""",
)
def _(t):
    return jobs.committee_shares(t.committee_votes)


@query(
    "stakeholder_approval",
    "decision_id:i all_approved:b stakeholders:i",
    """SELECT decision_id, bool_and(vote = 'approve') AS all_approved, count(*) AS stakeholders
       FROM committee_votes GROUP BY decision_id""",
)
def _(t):
    return jobs.stakeholder_approval(t.committee_votes)


@query(
    "template_usage",
    "template:s decision_type:s usage_count:i",
    """SELECT template, decision_type, coalesce(n, 0) AS usage_count FROM templates
       LEFT JOIN (SELECT decision_type, count(*) AS n FROM decisions GROUP BY ALL) USING (decision_type)""",
)
def _(t):
    return jobs.template_usage(t.decisions, t.templates)


@query(
    "prefilled_decisions",
    "id:i summary:s rationale:s timeline_days:i",
    """SELECT id, CASE WHEN id % 2 = 0 THEN summary ELSE summary_template END AS summary, rationale,
              CASE WHEN d.timeline_days > 0 THEN d.timeline_days ELSE default_timeline_days END AS timeline_days
       FROM decisions d JOIN templates USING (decision_type)""",
)
def _(t):
    gaps = t.decisions.withColumns(
        {
            "summary": F.when(F.col("id") % 2 == 0, F.col("summary")),
            "timeline_days": F.when(F.col("timeline_days") > 0, F.col("timeline_days")),
        }
    )
    return jobs.prefill(gaps, t.templates)


def metrics_of(t):
    return idea_jobs.idea_metrics(t.rated_ideas, t.votes, t.comments, AS_OF)


@query(
    "decision_snapshots",
    "id:i idea_id:i views:i rating:f engagement:f",
    """SELECT id, idea_id, total_votes AS views, avg_rating AS rating, engagement_score AS engagement
       FROM decisions LEFT JOIN (SELECT idea_id, total_votes, avg_rating, engagement_score FROM idea_metrics) USING (idea_id)""",
)
def _(t):
    out = jobs.with_metrics_snapshot(t.decisions, metrics_of(t))

    def part(name):
        return F.get_json_object("metrics_snapshot", f"$.{name}").cast("double")

    return out.select(
        "id",
        "idea_id",
        part("total_votes").alias("views"),
        part("avg_rating").alias("rating"),
        part("engagement_score").alias("engagement"),
    )


@query(
    "created_event_records",
    "decision_id:i event_type:s event_data:s actor_id:s occurred_at:t",
    """SELECT id AS decision_id, 'decision_created' AS event_type,
              '{"idea_id":' || idea_id || ',"decision_type":"' || decision_type || '","initial_status":"' || status
              || '","summary":"' || summary || '"}' AS event_data, decided_by AS actor_id, created_at AS occurred_at
       FROM decisions""",
)
def _(t):
    return jobs.created_events(t.decisions)


@query(
    "status_event_records",
    "decision_id:i event_type:s event_data:s occurred_at:t",
    """SELECT id AS decision_id, 'status_changed' AS event_type,
              '{"old_status":"pending","new_status":"' || status || '","reason":null}' AS event_data, decided_at AS occurred_at
       FROM decisions WHERE decided_at IS NOT NULL""",
)
def _(t):
    changes = t.decisions.where(F.col("decided_at").isNotNull()).select(
        "id",
        "decided_by",
        F.lit("pending").alias("old_status"),
        F.col("status").alias("new_status"),
        F.lit(None).cast("string").alias("reason"),
        F.col("decided_at").alias("changed_at"),
    )
    return jobs.status_events(changes)


@query(
    "reversal_records",
    "decision_id:i event_type:s event_data:s",
    """SELECT id AS decision_id, 'decision_reversed' AS event_type,
              '{"old_status":"approved","new_status":"reversed","reason":"budget"}' AS event_data
       FROM decisions WHERE status = 'approved' AND implemented_at IS NULL""",
)
def _(t):
    return jobs.reversal_events(t.decisions, F.col("decided_at"), "budget")


@query(
    "reversed_decisions",
    "decision_id:i status:s",
    """SELECT id AS decision_id, CASE WHEN status = 'approved' THEN 'reversed' ELSE status END AS status
       FROM decisions WHERE decided_at IS NOT NULL""",
)
def _(t):
    changes = t.decisions.where(F.col("decided_at").isNotNull()).select(
        "id",
        "decided_by",
        F.lit("pending").alias("old_status"),
        F.col("status").alias("new_status"),
        F.lit(None).cast("string").alias("reason"),
        F.col("decided_at").alias("changed_at"),
    )
    later = F.col("decided_at") + F.expr("INTERVAL 1 DAY")
    log = jobs.status_events(changes).unionByName(jobs.reversal_events(t.decisions, later, "budget"))
    return jobs.replay(log.withColumn("sequence", F.lit(0)))


# ---------------------------------------------------------------- rules


def success_metrics(t):
    return metrics_of(t).select(
        "idea_id",
        F.col("total_votes").alias("vote_count"),
        "engagement_score",
        F.col("avg_rating").alias("average_rating"),
        "controversy_score",
        ((F.col("idea_id") % 100) / F.lit(100.0)).alias("success_probability"),
        "status",
        "days_since_created",
    )


def suggestions_of(t):
    return rules.suggest_decisions(success_metrics(t), t.criteria)


@query(
    "decision_suggestions",
    "idea_id:i suggested_decision_type:s confidence_score:f matching_criteria:l auto_approve_eligible:b needs_review:b",
    "SELECT * FROM suggestions",
)
def _(t):
    return suggestions_of(t)


@query(
    "suggestions_without_prediction",
    "idea_id:i confidence_score:f match_count:i auto_approve_eligible:b",
    """SELECT idea_id, coalesce(max(tenths) FILTER (WHERE hits >= 3) / 10.0::DOUBLE, 0.3) AS confidence_score,
              count(*) FILTER (WHERE hits >= 3) AS match_count, false AS auto_approve_eligible
       FROM (SELECT idea_id, 2 * (vote_count >= min_vote_count)::INT + 2 * (engagement_score >= min_engagement_score)::INT
                    + 2 * (average_rating >= min_average_rating)::INT + (controversy_score <= max_controversy_score)::INT AS tenths,
                    (vote_count >= min_vote_count)::INT + (engagement_score >= min_engagement_score)::INT
                    + (average_rating >= min_average_rating)::INT + (controversy_score <= max_controversy_score)::INT AS hits
             FROM success_metrics m, criteria c WHERE c.is_active) GROUP BY idea_id""",
)
def _(t):
    metrics = success_metrics(t).drop("success_probability")
    out = rules.suggest_decisions(metrics, t.criteria)
    return out.withColumn("match_count", F.size("matching_criteria"))


STRICT = rules.Criterion(
    1, "strict", min_vote_count=20, min_engagement_score=10.0, min_average_rating=2.5, max_controversy_score=0.6
)


@query(
    "ideas_meeting_all_criteria",
    "idea_id:i meets_criteria:b suggested_decision:s meets_votes:b meets_age:b",
    """SELECT *, CASE WHEN meets_criteria THEN 'implementation' ELSE 'deferral' END AS suggested_decision FROM (
       SELECT idea_id, vote_count >= 20 AS meets_votes, days_since_created >= 7 AS meets_age,
              vote_count >= 20 AND engagement_score >= 10 AND average_rating >= 2.5 AND controversy_score <= 0.6
              AND days_since_created >= 7 AS meets_criteria
       FROM success_metrics)""",
)
def _(t):
    return rules.meets_all(success_metrics(t), STRICT)


@query(
    "batch_decision_summary",
    "outcome:s idea_count:i avg_confidence:f",
    """SELECT CASE WHEN auto_approve_eligible THEN 'auto_approved' WHEN suggested_decision_type = 'deferral' THEN 'deferred'
                   ELSE 'manual_review' END AS outcome, count(*) AS idea_count, avg(confidence_score) AS avg_confidence
       FROM suggestions GROUP BY ALL""",
)
def _(t):
    return rules.batch_summary(suggestions_of(t))


@query(
    "criteria_quality",
    "true_positives:i false_positives:i false_negatives:i true_negatives:i false_positive_rate:f false_negative_rate:f",
    """SELECT *, false_positives / (false_positives + true_negatives)::DOUBLE AS false_positive_rate,
              false_negatives / (false_negatives + true_positives)::DOUBLE AS false_negative_rate
       FROM (SELECT count(*) FILTER (WHERE p AND s) AS true_positives, count(*) FILTER (WHERE p AND NOT s) AS false_positives,
                    count(*) FILTER (WHERE NOT p AND s) AS false_negatives, count(*) FILTER (WHERE NOT p AND NOT s) AS true_negatives
             FROM (SELECT suggested_decision_type = 'implementation' AS p, status = 'implemented' AS s
                   FROM suggestions JOIN (SELECT idea_id, status FROM ideas) USING (idea_id)))""",
)
def _(t):
    outcomes = t.ideas.select("idea_id", (F.col("status") == "implemented").alias("succeeded"))
    return rules.criteria_quality(suggestions_of(t), outcomes)


@query(
    "decision_warnings",
    "id:i finding:s severity:s",
    """SELECT id, CASE WHEN decision_type = 'implementation' THEN 'score_too_low' ELSE 'high_score_rejected' END AS finding,
              CASE WHEN decision_type = 'implementation' THEN 'error' ELSE 'warning' END AS severity
       FROM decisions WHERE (decision_type = 'implementation' AND success_probability < 0.5)
          OR (decision_type = 'rejection' AND success_probability >= 0.8)""",
)
def _(t):
    return rules.decision_warnings(t.decisions, "success_probability")


@query(
    "escalated_ideas",
    "idea_id:i controversy_score:f",
    """SELECT * FROM (
       SELECT idea_id, 0.7 * least(u, d) / (u + d)::DOUBLE + 0.3 * least(coalesce(v, 0) / 4, 1) AS controversy_score, u + d AS n
       FROM ideas JOIN (SELECT idea_id, count(*) FILTER (WHERE vote_type = 'upvote') AS u,
                               count(*) FILTER (WHERE vote_type = 'downvote') AS d, var_pop(rating) AS v
                        FROM votes GROUP BY idea_id) USING (idea_id) WHERE u + d > 0)
       WHERE n >= 20 AND controversy_score > 0.4""",
)
def _(t):
    return idea_jobs.controversial_ideas(t.ideas, t.votes, threshold=0.4, min_votes=20)


@query(
    "metric_alerts",
    "event_id:i metric_name:s metric_value:f component:s threshold:f",
    """SELECT * FROM (SELECT *, CASE metric_name WHEN 'cpu_usage' THEN 80 WHEN 'memory_usage' THEN 85 WHEN 'response_time' THEN 2000
                                     WHEN 'error_rate' THEN 5 END AS threshold FROM system_metrics)
       WHERE metric_value > threshold""",
)
def _(t):
    return rules.metric_alerts(t.system_metrics)


@query(
    "metric_alerts_from_table",
    "event_id:i metric_name:s metric_value:f threshold:f",
    """SELECT event_id, metric_name, metric_value, threshold FROM system_metrics
       JOIN (SELECT metric_name, avg(metric_value) * 2 AS threshold FROM system_metrics GROUP BY metric_name) USING (metric_name)
       WHERE metric_value > threshold""",
)
def _(t):
    limits = t.system_metrics.groupBy("metric_name").agg((F.avg("metric_value") * 2).alias("threshold"))
    return rules.metric_alerts_from_table(t.system_metrics, limits)


@query(
    "low_sentiment_alerts",
    "thought_id:i user_id:s sentiment_score:f",
    "SELECT * FROM thoughts WHERE sentiment_score < -0.7",
)
def _(t):
    return rules.low_sentiment(t.thoughts)
