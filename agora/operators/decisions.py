"""Decision searches and statistics, and projections of the decision event log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from agora.functions import scores, text, timeparts
from agora.operators import skew

# Event names whose payload sets an attribute of the decision. Two names are
# in use for a metrics snapshot.
STATUS_CHANGED = "status_changed"
METRICS_EVENTS = ("metrics_updated", "metrics_snapshot_taken")
PLAN_EVENT = "implementation_plan_updated"
COMMITTEE_EVENT = "committee_assigned"
CONDITIONS_EVENT = "conditions_updated"
REVERSED_EVENT = "decision_reversed"

# Statuses a decision may be in before it moves to the given one.
ALLOWED_BEFORE = {"approved": ("pending",), "rejected": ("pending", "in_review")}

EVENT_ORDER = ("occurred_at", "sequence")


def search_decisions(
    decisions: DataFrame,
    as_of: datetime | str,
    status: str | None = None,
    decision_type: str | None = None,
    idea_id: int | None = None,
    decided_by: str | None = None,
    days_back: int = 30,
) -> DataFrame:
    """Decisions of the last 1 to 365 days meeting all given conditions."""
    if not 1 <= days_back <= 365:
        raise ValueError("days_back must be between 1 and 365")
    found = decisions.where(F.col("created_at") >= timeparts.hours_before(as_of, 24 * days_back))
    for name, value in (
        ("status", status),
        ("decision_type", decision_type),
        ("idea_id", idea_id),
        ("decided_by", decided_by),
    ):
        if value is not None:
            found = found.where(F.col(name) == value)
    return found


def list_decisions(found: DataFrame, events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest decisions with the number of their events."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    newest = found.orderBy(F.desc("created_at"), "id").limit(limit)
    return with_event_count(newest, events)


def with_event_count(decisions: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.groupBy(F.col("decision_id").alias("id")).agg(F.count(F.lit(1)).alias("events_count"))
    return decisions.join(counts, "id", "left").fillna(0, ["events_count"])


def decision_with_events(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Decisions with their events, one row per event (one row for a decision without any).

    Rows instead of a nested list: a list would pull all events of a decision into one
    record. The adaptive skew join splits a decision with very many events.
    """
    log = events.select(
        F.col("decision_id").alias("id"), "event_id", "event_type", "actor_id", "occurred_at", "sequence"
    )
    head = decisions.select("id", "idea_id", "decision_type", "status")
    # An inner join, because only there a hot decision's events can be split; the rest is added.
    matched = log.join(head, "id")
    without = head.join(log.select("id").distinct(), "id", "left_anti")
    return matched.unionByName(without, allowMissingColumns=True)


def recent_decisions(decisions: DataFrame, n: int = 10) -> DataFrame:
    return decisions.orderBy(F.desc("created_at"), "id").limit(n)


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Decisions per status and per type, in one pass: one row per (dimension, value)."""
    pairs = decisions.select(
        F.explode(
            F.array(
                F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")),
                F.struct(F.lit("type").alias("dimension"), F.col("decision_type").alias("value")),
            )
        ).alias("p")
    )
    return pairs.groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("decision_count"))


def decision_times(decisions: DataFrame) -> DataFrame:
    """Number of decisions and the mean days to decide and to implement, one row."""
    return decisions.agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.avg(timeparts.days_between("created_at", "decided_at")).alias("average_time_to_decision"),
        F.avg(timeparts.days_between("decided_at", "implemented_at")).alias("average_implementation_time"),
    )


def with_impact(decisions: DataFrame) -> DataFrame:
    """Return on investment, risk-adjusted probability, expected value and risk level."""
    cost, revenue, chance, risks = "estimated_cost", "estimated_revenue", "success_probability", "risk_factors"
    return (
        decisions.withColumn("roi_estimate", scores.roi(cost, revenue))
        .withColumn("adjusted_success_probability", scores.adjusted_probability(chance, risks))
        .withColumn("expected_value", scores.expected_value(cost, revenue, chance, risks))
        .withColumn("risk_level", scores.risk_level(risks))
    )


def roi_by_category(decisions: DataFrame, ideas: DataFrame) -> DataFrame:
    """Investment, benefit, ROI, success rate and implementation time per idea category.

    Decisions are summed per idea before the join with the ideas.
    """
    done = F.col("status") == "implemented"
    days = timeparts.days_between("decided_at", "implemented_at")
    per_idea = decisions.groupBy("idea_id").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(done).alias("implemented"),
        F.sum(F.when(done, F.col("estimated_cost"))).alias("cost"),
        F.sum(F.when(done, F.col("estimated_revenue"))).alias("benefit"),
        F.sum(F.when(done, days)).alias("days"),
    )
    return (
        per_idea.join(ideas.select("idea_id", "category"), "idea_id")
        .groupBy("category")
        .agg(
            F.sum("implemented").alias("ideas_implemented"),
            F.sum("cost").alias("total_investment"),
            F.sum("benefit").alias("measured_benefits"),
            F.sum("decisions").alias("_decisions"),
            F.sum("days").alias("_days"),
        )
        .withColumn("roi", scores.roi("total_investment", "measured_benefits"))
        .withColumn("success_rate", scores.ratio("ideas_implemented", "_decisions"))
        .withColumn("avg_implementation_days", scores.ratio("_days", "ideas_implemented"))
        .drop("_decisions", "_days")
    )


# ---------------------------------------------------------------- event records


def _event(source: DataFrame, event_type: str, payload: Column, at: Column, **actor: Column) -> DataFrame:
    return source.select(
        F.col("id").alias("decision_id"),
        F.lit(event_type).alias("event_type"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("event_data"),
        actor.get("actor_id", F.col("decided_by")).alias("actor_id"),
        actor.get("actor_name", F.lit(None).cast("string")).alias("actor_name"),
        actor.get("actor_role", F.lit(None).cast("string")).alias("actor_role"),
        at.alias("occurred_at"),
    )


def created_events(decisions: DataFrame) -> DataFrame:
    payload = F.struct("idea_id", "decision_type", F.col("status").alias("initial_status"), "summary")
    return _event(
        decisions, "decision_created", payload, F.col("created_at"), actor_role=F.lit("decision_maker")
    )


def status_events(changes: DataFrame, actor_role: str = "decision_maker") -> DataFrame:
    """``changes`` holds id, old_status, new_status, reason, decided_by and changed_at."""
    payload = F.struct("old_status", "new_status", "reason")
    return _event(changes, STATUS_CHANGED, payload, F.col("changed_at"), actor_role=F.lit(actor_role))


def snapshot_events(decisions: DataFrame, metrics: Column, at: Column) -> DataFrame:
    payload = F.struct(metrics.alias("metrics"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("snapshot_time"))
    return _event(decisions, "metrics_snapshot_taken", payload, at)


def committee_events(decisions: DataFrame, at: Column) -> DataFrame:
    members = F.col("decision_committee")
    payload = F.struct(members.alias("committee"), F.size(members).alias("committee_size"))
    return _event(decisions, COMMITTEE_EVENT, payload, at, actor_role=F.lit("decision_maker"))


def plan_events(decisions: DataFrame, at: Column) -> DataFrame:
    payload = F.struct(F.col("implementation_plan").alias("plan"), "timeline_days")
    return _event(decisions, PLAN_EVENT, payload, at, actor_role=F.lit("decision_maker"))


def committee_vote_events(votes: DataFrame, at: Column) -> DataFrame:
    """One event per committee member's vote (decision_id, member_id, vote, rationale)."""
    return votes.select(
        "decision_id",
        F.lit("committee_vote_cast").alias("event_type"),
        F.to_json(F.struct("vote", "rationale")).alias("event_data"),
        F.col("member_id").alias("actor_id"),
        F.concat(F.lit("Committee Member "), F.col("member_id")).alias("actor_name"),
        at.alias("occurred_at"),
    )


# ---------------------------------------------------------------- projections


def decision_history(events: DataFrame, decision_id: int | None = None) -> DataFrame:
    """Events of one or of all decisions in the order they happened."""
    log = events if decision_id is None else events.where(F.col("decision_id") == decision_id)
    return log.orderBy("decision_id", *EVENT_ORDER)


def timeline(events: DataFrame) -> DataFrame:
    """Timeline entries: time, type, actor and details."""
    return events.select(
        "decision_id",
        F.col("occurred_at").alias("timestamp"),
        "sequence",
        "event_type",
        F.struct(
            F.col("actor_id").alias("id"), F.col("actor_name").alias("name"), F.col("actor_role").alias("role")
        ).alias("actor"),
        F.col("event_data").alias("details"),
    ).orderBy("decision_id", "timestamp", "sequence")


def audit_trail(events: DataFrame, event_types: Sequence[str] | None = None) -> DataFrame:
    """Newest first, optionally only some event types, with a readable actor."""
    log = events if not event_types else events.where(F.col("event_type").isin(list(event_types)))
    return log.orderBy(F.desc("occurred_at"), F.desc("sequence"), "event_id").select(
        "event_id",
        "decision_id",
        F.col("occurred_at").alias("timestamp"),
        "event_type",
        text.label("actor_name", "actor_id", "actor_role").alias("actor"),
        F.col("event_data").alias("changes"),
    )


def replay(events: DataFrame) -> DataFrame:
    """State of every decision after all its events.

    Each attribute is the value of the newest event that sets it, found by ``max_by``,
    which combines on the map side, so a long log of one decision needs no sort.
    """
    order = F.struct(*EVENT_ORDER)
    kind = F.col("event_type")
    events = events.withColumn(
        "_new_status", F.when(kind == STATUS_CHANGED, F.get_json_object("event_data", "$.new_status"))
    )
    new_status = F.col("_new_status")
    is_status = (kind == STATUS_CHANGED) | (kind == REVERSED_EVENT)
    status = F.when(kind == REVERSED_EVENT, "reversed").otherwise(new_status)
    approved = (kind == STATUS_CHANGED) & (new_status == "approved")
    implemented = (kind == STATUS_CHANGED) & (new_status == "implemented")

    def newest(condition: Column, value: Column) -> Column:
        # A null order never wins. The condition guards the value too, so the payload of
        # an event is parsed only for the attribute it sets.
        return F.max_by(F.when(condition, value), F.when(condition, order))

    return events.groupBy("decision_id").agg(
        newest(is_status, status).alias("status"),
        newest(approved, F.col("occurred_at")).alias("decided_at"),
        newest(approved, F.col("actor_id")).alias("decided_by"),
        newest(implemented, F.col("occurred_at")).alias("implemented_at"),
        newest(kind.isin(*METRICS_EVENTS), F.get_json_object("event_data", "$.metrics")).alias(
            "metrics_snapshot"
        ),
        newest(kind == PLAN_EVENT, F.get_json_object("event_data", "$.plan")).alias("implementation_plan"),
        newest(kind == COMMITTEE_EVENT, F.get_json_object("event_data", "$.committee")).alias(
            "decision_committee"
        ),
        newest(kind == CONDITIONS_EVENT, F.get_json_object("event_data", "$.conditions")).alias("conditions"),
        F.count(F.lit(1)).alias("event_count"),
    )


def status_moves(events: DataFrame, initial_status: str = "pending") -> DataFrame:
    """Status changes with the status before them and whether the move was allowed."""
    moves = events.where(F.col("event_type") == STATUS_CHANGED).withColumn(
        "new_status", F.get_json_object("event_data", "$.new_status")
    )
    chained = skew.over_history(
        moves,
        keys=["decision_id"],
        time="occurred_at",
        tie=["sequence"],
        needs=["new_status"],
        depth=1,
        columns=lambda w: {"old_status": F.lag("new_status").over(w)},
    ).withColumn("old_status", F.coalesce("old_status", F.lit(initial_status)))
    allowed = F.lit(True)
    for target, sources in ALLOWED_BEFORE.items():
        allowed = F.when(F.col("new_status") == target, F.col("old_status").isin(*sources)).otherwise(allowed)
    return chained.withColumn("is_valid", allowed)


def _in_period(events: DataFrame, start: datetime | str | None, end: datetime | str | None) -> DataFrame:
    """Both ends inclusive."""
    if start is not None:
        events = events.where(F.col("occurred_at") >= timeparts.moment(start))
    if end is not None:
        events = events.where(F.col("occurred_at") <= timeparts.moment(end))
    return events


def actor_activity(
    events: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None
) -> DataFrame:
    """Actions in total, per event type (a map) and distinct decisions per actor."""
    log = _in_period(events, start, end)
    per_type = log.groupBy("actor_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    counts = per_type.groupBy("actor_id").agg(
        F.sum("n").alias("total_actions"),
        # One entry per event type.
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("actions_by_type"),
    )
    affected = log.groupBy("actor_id").agg(F.count_distinct("decision_id").alias("decisions_affected"))
    return counts.join(affected, "actor_id")


def actor_decisions(events: DataFrame) -> DataFrame:
    """The decisions each actor touched, one row each."""
    return events.select("actor_id", "decision_id").distinct()


def actor_recent_actions(
    events: DataFrame, n: int = 10, start: datetime | str | None = None, end: datetime | str | None = None
) -> DataFrame:
    """The ``n`` newest actions per actor; each task keeps only ``n`` per actor before the shuffle."""
    newest = Window.partitionBy("actor_id").orderBy(F.desc("occurred_at"), F.desc("sequence"), "decision_id")
    return (
        _in_period(events, start, end)
        .withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= n)
        .select("actor_id", "position", F.col("occurred_at").alias("timestamp"), "event_type", "decision_id")
    )


# ---------------------------------------------------------------- committees and coordination


def committee_results(votes: DataFrame, weighted: bool = True) -> DataFrame:
    """Winner, consensus and the decision status that follows, per decision.

    One row per decision and option is left after the first aggregation. A tie goes to
    the option that comes first in the alphabet.
    """
    weight = F.col("weight") if weighted else F.lit(1.0)
    options = votes.groupBy("decision_id", "vote").agg(
        F.sum(weight).alias("option_weight"), F.count(F.lit(1)).alias("n")
    )
    result = options.groupBy("decision_id").agg(
        F.min_by("vote", F.struct(-F.col("option_weight"), F.col("vote"))).alias("final_decision"),
        F.max("option_weight").alias("_best"),
        F.sum("option_weight").alias("_total"),
        F.count(F.lit(1)).alias("option_count"),
        F.sum("n").alias("vote_count"),
    )
    return (
        result.withColumn("consensus_share", F.col("_best") / F.col("_total") * 100)
        .withColumn("unanimous", F.col("option_count") == 1)
        .withColumn(
            "consensus_level",
            F.when(F.col("option_count") == 1, "unanimous")
            .when((F.col("option_count") == 2) & (F.col("vote_count") > 2), "majority")
            .otherwise("split"),
        )
        .withColumn("status", F.when(F.col("final_decision") == "approve", "approved").otherwise("in_review"))
        .drop("_best", "_total")
    )


def committee_shares(votes: DataFrame) -> DataFrame:
    """Weight and percentage of every option per decision."""
    options = votes.groupBy("decision_id", "vote").agg(F.sum("weight").alias("option_weight"))
    total = F.sum("option_weight").over(Window.partitionBy("decision_id"))
    return options.withColumn("percentage", F.col("option_weight") / total * 100)


def stakeholder_approval(votes: DataFrame) -> DataFrame:
    """Whether all stakeholders of a decision approved."""
    return votes.groupBy("decision_id").agg(
        F.bool_and(F.col("vote") == "approve").alias("all_approved"),
        F.count(F.lit(1)).alias("stakeholders"),
    )


def template_usage(decisions: DataFrame, templates: DataFrame) -> DataFrame:
    """How often each template's decision type was used."""
    used = decisions.groupBy("decision_type").agg(F.count(F.lit(1)).alias("usage_count"))
    return templates.join(used, "decision_type", "left").fillna(0, ["usage_count"])


def prefill(decisions: DataFrame, templates: DataFrame) -> DataFrame:
    """Fill empty summary, rationale and timeline from the template of the decision's type.

    There are few types, so each is hot: Spark broadcasts the templates, or splits the types.
    """
    filled = decisions.join(templates, "decision_type", "left")
    return filled.select(
        "id",
        "decision_type",
        F.coalesce("summary", "summary_template").alias("summary"),
        F.coalesce("rationale", "rationale_template").alias("rationale"),
        F.coalesce("timeline_days", "default_timeline_days").alias("timeline_days"),
    )


def with_metrics_snapshot(decisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Decisions with the metrics of their idea as a JSON text.

    Many decisions may concern one idea; the adaptive skew join splits hot ideas.
    """
    snapshot = metrics.select(
        "idea_id",
        F.to_json(F.struct("total_votes", "avg_rating", "engagement_score", "comment_count")).alias(
            "metrics_snapshot"
        ),
    )
    return decisions.join(snapshot, "idea_id", "left")


def reversal_events(decisions: DataFrame, at: Column, reason: str) -> DataFrame:
    """Reversal of approved decisions whose implementation has not begun."""
    open_ones = decisions.where((F.col("status") == "approved") & F.col("implemented_at").isNull())
    payload = F.struct(F.col("status").alias("old_status"), F.lit("reversed").alias("new_status"), F.lit(reason).alias("reason"))
    return _event(open_ones, REVERSED_EVENT, payload, at, actor_role=F.lit("decision_maker"))
