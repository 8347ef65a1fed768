import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from agora.operators import decisions as jobs
from agora.operators import rules
from agora.operators.rules import Criterion

T0 = datetime(2024, 1, 1)
LOG = (
    "event_id string, decision_id long, event_type string, event_data string, actor_id string, actor_name string,"
    " actor_role string, occurred_at timestamp, sequence long"
)


def log(spark, events):
    rows = [
        (f"e{i}", d, kind, json.dumps(data), actor, None, None, T0 + timedelta(days=i), i)
        for i, (d, kind, data, actor) in enumerate(events)
    ]
    return spark.createDataFrame(rows, LOG)


def moved(decision, status, actor="m"):
    return (decision, "status_changed", {"new_status": status}, actor)


def test_replay_restores_the_state(spark):
    events = [
        moved(1, "in_review"),
        moved(1, "approved", "boss"),
        moved(1, "implemented"),
        (1, "metrics_updated", {"metrics": {"views": 1}}, "m"),
        (1, "metrics_snapshot_taken", {"metrics": {"views": 2}}, "m"),
        (1, "committee_assigned", {"committee": ["a", "b"]}, "m"),
        moved(2, "rejected"),
    ]
    state = {r.decision_id: r for r in jobs.replay(log(spark, events)).collect()}
    one, two = state[1], state[2]
    assert (one.status, one.decided_by, one.event_count) == ("implemented", "boss", 6)
    assert one.decided_at == T0 + timedelta(days=1) and one.implemented_at == T0 + timedelta(days=2)
    assert json.loads(one.metrics_snapshot) == {"views": 2} and json.loads(one.decision_committee) == ["a", "b"]
    assert (two.status, two.decided_at, two.implementation_plan) == ("rejected", None, None)


def test_moves_are_checked_against_the_status_before(spark):
    events = [moved(1, "approved"), moved(1, "approved"), moved(2, "in_review"), moved(2, "rejected"), moved(3, "implemented")]
    got = [(r.decision_id, r.old_status, r.new_status, r.is_valid) for r in jobs.status_moves(log(spark, events)).orderBy("sequence").collect()]
    assert got == [
        (1, "pending", "approved", True),
        (1, "approved", "approved", False),
        (2, "pending", "in_review", True),
        (2, "in_review", "rejected", True),
        (3, "pending", "implemented", True),
    ]


def test_weighted_committee(spark):
    rows = [(1, "m1", "approve", 1.0), (1, "m2", "approve", 1.0), (1, "m3", "modify", 1.0), (1, "m4", "approve", 1.5)]
    votes = spark.createDataFrame(rows, "decision_id long, member_id string, vote string, weight double")
    row = jobs.committee_results(votes).first()
    assert (row.final_decision, row.unanimous, row.status) == ("approve", False, "approved")
    assert row.consensus_share == pytest.approx(77.777778, abs=1e-6)
    shares = {r.vote: r.percentage for r in jobs.committee_shares(votes).collect()}
    assert shares == pytest.approx({"approve": 77.777778, "modify": 22.222222}, abs=1e-5)


@pytest.mark.parametrize(
    "votes, winner, level, status",
    [
        (["approve", "approve", "modify"], "approve", "majority", "approved"),
        (["modify", "modify"], "modify", "unanimous", "in_review"),
        (["approve", "reject"], "approve", "split", "approved"),
        (["approve", "reject", "modify"], "approve", "split", "approved"),
    ],
)
def test_unweighted_committee(spark, votes, winner, level, status):
    rows = [(1, f"m{i}", v, 1.0) for i, v in enumerate(votes)]
    table = spark.createDataFrame(rows, "decision_id long, member_id string, vote string, weight double")
    row = jobs.committee_results(table, weighted=False).first()
    assert (row.final_decision, row.consensus_level, row.status) == (winner, level, status)


METRICS = "idea_id int, vote_count int, engagement_score double, average_rating double, controversy_score double"


def suggest(spark, criteria, row=(1, 35, 0.78, 4.3, 0.2), probability=None):
    table = spark.createDataFrame([row], METRICS)
    if probability is not None:
        table = table.withColumn("success_probability", F.lit(probability))
    return rules.suggest_decisions(table, criteria).first()


def test_only_the_second_criterion_matches(spark):
    criteria = [
        Criterion(1, "strict", min_vote_count=1000, min_engagement_score=9.0, min_average_rating=4.9),
        Criterion(2, "fair", suggested_decision_type="modification"),
    ]
    got = suggest(spark, criteria)
    assert (got.suggested_decision_type, got.confidence_score, got.matching_criteria) == ("modification", 0.7, ["fair"])
    assert got.needs_review and not got.auto_approve_eligible


def test_first_criterion_wins_a_tie(spark):
    criteria = [Criterion(7, "b", suggested_decision_type="escalation"), Criterion(3, "a", suggested_decision_type="rejection")]
    assert suggest(spark, criteria).suggested_decision_type == "rejection"


def test_auto_approval_needs_a_prediction(spark):
    criteria = [Criterion(1, "auto", auto_approve=True)]
    assert not suggest(spark, criteria).auto_approve_eligible
    got = suggest(spark, criteria, probability=0.9)
    assert got.auto_approve_eligible and got.confidence_score == 1.0 and not got.needs_review


def test_default_is_a_deferral(spark):
    got = suggest(spark, [Criterion(1, "strict", min_vote_count=99, min_engagement_score=9.0)], row=(1, 1, None, None, None))
    assert (got.suggested_decision_type, got.confidence_score, got.matching_criteria) == ("deferral", 0.3, [])
    assert suggest(spark, []).suggested_decision_type == "deferral"


def test_criteria_from_a_table(spark):
    criteria = [Criterion(i, f"c{i}", min_vote_count=i * 10, min_engagement_score=9.0, min_average_rating=3.0) for i in range(1, 6)]
    table = spark.createDataFrame([vars(c) | {"category": "x"} for c in criteria])
    for given in (criteria, table):
        got = suggest(spark, given, row=(1, 35, 0.0, 4.0, 0.1))
        assert got.matching_criteria == ["c1", "c2", "c3"]
    assert suggest(spark, table.limit(0)).suggested_decision_type == "deferral"
    inactive = table.select("criteria_id", "name", F.lit(False).alias("is_active"))
    assert suggest(spark, inactive).matching_criteria == []


def test_the_plan_does_not_grow_with_the_criteria(spark):
    table = lambda n: spark.range(1, n).select(F.col("id").cast("int").alias("criteria_id"), F.lit("c").alias("name"))
    metrics = spark.createDataFrame([(1, 35, 0.78, 4.3, 0.2)], METRICS)
    size = lambda n: len(rules.suggest_decisions(metrics, table(n))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(10) - size(30_000)) < 200


def test_criteria_table_round_trip(spark):
    table = spark.createDataFrame([(4, "x", 25, True), (5, "y", None, False)], "criteria_id int, name string, min_vote_count int, is_active boolean")
    loaded = rules.load_criteria(table)
    assert loaded[0] == Criterion(4, "x", min_vote_count=25) and loaded[1].min_vote_count == 10
    assert len(rules.load_criteria(rules.active_criteria(table))) == 1


def test_all_thresholds_at_once(spark):
    row = (1, 35, 0.78, 4.3, 0.2, 14)
    table = spark.createDataFrame([row, (2, 35, 0.78, 4.3, 0.2, 3)], METRICS + ", days_since_created int")
    strict = Criterion(1, "s", min_vote_count=20, min_average_rating=4.0, min_engagement_score=0.7, max_controversy_score=0.3)
    got = {r.idea_id: (r.meets_criteria, r.suggested_decision) for r in rules.meets_all(table, strict).collect()}
    assert got == {1: (True, "implementation"), 2: (False, "deferral")}


def test_event_records(spark):
    decisions = spark.createDataFrame(
        [(1, 5, "implementation", "pending", "A summary", "u", ["x", "y"], "do it", 30, T0)],
        "id long, idea_id int, decision_type string, status string, summary string, decided_by string,"
        " decision_committee array<string>, implementation_plan string, timeline_days int, created_at timestamp",
    )
    at = F.col("created_at")
    row = jobs.created_events(decisions).first()
    assert json.loads(row.event_data) == {"idea_id": 5, "decision_type": "implementation", "initial_status": "pending", "summary": "A summary"}
    assert json.loads(jobs.committee_events(decisions, at).first().event_data) == {"committee": ["x", "y"], "committee_size": 2}
    assert json.loads(jobs.plan_events(decisions, at).first().event_data) == {"plan": "do it", "timeline_days": 30}
    snap = json.loads(jobs.snapshot_events(decisions, F.struct(F.lit(3).alias("views")), at).first().event_data)
    assert snap == {"metrics": {"views": 3}, "snapshot_time": "2024-01-01T00:00:00"}
    votes = spark.createDataFrame([(1, "m1", "approve", "fine")], "decision_id long, member_id string, vote string, rationale string")
    event = jobs.committee_vote_events(votes, F.lit(T0)).first()
    assert (event.event_type, event.actor_name) == ("committee_vote_cast", "Committee Member m1")


def test_warnings(spark):
    rows = [("implementation", "approved", 0.9), ("implementation", "approved", 0.3), ("rejection", "rejected", 0.9), ("", "approved", 0.8), ("implementation", "", 0.8)]
    table = spark.createDataFrame(rows, "decision_type string, status string, score double")
    got = [(r.finding, r.severity) for r in rules.decision_warnings(table).collect()]
    assert sorted(got) == [("high_score_rejected", "warning"), ("score_too_low", "error"), ("status_required", "error"), ("type_required", "error")]


def test_alerts_are_strict(spark):
    table = spark.createDataFrame([("cpu_usage", 80.0), ("cpu_usage", 80.1), ("other", 1e9)], "metric_name string, metric_value double")
    assert [r.metric_value for r in rules.metric_alerts(table).collect()] == [80.1]


def test_actor_summary(spark):
    events = log(spark, [moved(1, "approved", "a"), moved(2, "approved", "a"), (2, "committee_assigned", {}, "a"), moved(3, "rejected", "b")])
    got = {r.actor_id: (r.total_actions, r.actions_by_type, r.decisions_affected) for r in jobs.actor_activity(events).collect()}
    assert got["a"] == (3, {"status_changed": 2, "committee_assigned": 1}, 2)
    recent = jobs.actor_recent_actions(events, n=2).where("actor_id = 'a'").orderBy("position").collect()
    assert [r.event_type for r in recent] == ["committee_assigned", "status_changed"]


def test_search_limits(spark):
    table = spark.createDataFrame([(1, "pending", T0)], "id long, status string, created_at timestamp")
    with pytest.raises(ValueError):
        jobs.search_decisions(table, T0, days_back=400)
    assert jobs.search_decisions(table, "2024-01-10 00:00:00", status="pending").count() == 1
    assert jobs.search_decisions(table, "2024-03-10 00:00:00", status="pending").count() == 0
