from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from agora import schemas
from agora.operators import ideas as idea_jobs
from agora.operators import users as user_jobs
from agora.operators import votes as jobs

T0 = datetime(2024, 1, 1)


def votes(spark, rows):
    full = [
        (i + 1, idea, user, kind, rating, "10.0.0.1", "agent", T0 + timedelta(minutes=i), None)
        for i, (idea, user, kind, rating) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.VOTES)


def ideas(spark, rows):
    full = [
        (i, f"Idea {i}", "some description", cat, status, user, user, 0, 0.0, 0, ["t"], T0, None)
        for i, cat, status, user in rows
    ]
    return spark.createDataFrame(full, schemas.IDEAS)


def comments(spark, rows):
    full = [(n, idea, user, "text", deleted, T0) for n, (idea, user, deleted) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.COMMENTS)


SEED_VOTES = [(1, "1", "upvote", None), (1, "3", "upvote", None), (1, "4", "upvote", None), (2, "1", "upvote", None), (2, "2", "upvote", None), (3, "1", "downvote", None)]
SEED_COMMENTS = [(1, "1", False), (1, "4", False), (2, "1", False), (2, "3", False), (2, "3", True)]
SEED_IDEAS = [(1, "improvement", "published", "2"), (2, "innovation", "published", "3"), (3, "innovation", "draft", "4")]


def test_idea_stats_do_not_multiply_votes_by_comments(spark):
    out = idea_jobs.idea_stats(ideas(spark, SEED_IDEAS), votes(spark, SEED_VOTES), comments(spark, SEED_COMMENTS))
    got = {r.idea_id: (r.total_votes, r.upvotes, r.downvotes, r.comment_count, r.score) for r in out.collect()}
    assert got == {1: (3, 3, 0, 2, 3), 2: (2, 2, 0, 2, 2), 3: (1, 0, 1, 0, -1)}


def test_rating_sums(spark):
    rows = [(1, "a", "upvote", None), (1, "b", "upvote", None), (2, "a", "downvote", None), (2, "b", "rating", 4.5)]
    got = {r.idea_id: r[1:] for r in jobs.rating_sums(votes(spark, rows)).collect()}
    assert got == {1: (2, 0, 0, 0.0), 2: (0, 1, 1, 4.5)}


def test_metrics_of_an_idea_without_votes_are_zero(spark):
    out = idea_jobs.idea_metrics(ideas(spark, [(9, "other", "draft", "2")]), votes(spark, SEED_VOTES), comments(spark, SEED_COMMENTS), "2024-01-05 12:00:00")
    row = out.first()
    assert (row.total_votes, row.unique_voters, row.avg_rating, row.rating_stddev, row.controversy_score) == (0, 0, 0.0, 0.0, 0.0)
    assert row.days_since_created == 4 and row.is_recent


def test_single_rating_has_no_spread(spark):
    row = jobs.vote_metrics(votes(spark, [(1, "a", "rating", 4.0)])).first()
    assert row.rating_stddev is None and row.avg_rating == 4.0


def test_newest_vote_replaces_earlier_ones(spark):
    rows = [(1, "a", "upvote", None), (1, "b", "upvote", None), (1, "a", "downvote", None)]
    got = {r.user_id: r.vote_type for r in jobs.latest_votes(votes(spark, rows)).collect()}
    assert got == {"a": "downvote", "b": "upvote"}
    assert [r.user_id for r in jobs.duplicate_votes(votes(spark, rows)).collect()] == ["a"]
    history = {r.vote_id: (r.previous_vote_type, r.is_change) for r in jobs.vote_history(votes(spark, rows)).collect()}
    assert history == {1: (None, False), 2: (None, False), 3: ("upvote", True)}


def test_vote_status_of_requested_ideas(spark):
    got = {r.idea_id: (r.has_voted, r.vote_type) for r in jobs.vote_status(votes(spark, SEED_VOTES), "1", [1, 3, 7]).collect()}
    assert got == {1: (True, "upvote"), 3: (True, "downvote"), 7: (False, None)}
    with pytest.raises(ValueError):
        jobs.vote_status(votes(spark, SEED_VOTES), "1", list(range(101)))


def test_experts_count_more(spark):
    experts = spark.createDataFrame([("1",)], "user_id string")
    got = {r.idea_id: (r.weighted_score, r.expert_endorsements) for r in jobs.weighted_scores(votes(spark, SEED_VOTES), experts).collect()}
    assert got == {1: (3.5, 1), 2: (2.5, 1), 3: (-1.5, 0)}


def test_user_present_on_one_side_only(spark):
    out = user_jobs.user_analytics(ideas(spark, SEED_IDEAS), votes(spark, SEED_VOTES), comments(spark, SEED_COMMENTS))
    got = {r.user_id: (r.ideas_created, r.total_votes_cast, r.comments_made) for r in out.collect()}
    assert got == {"1": (0, 3, 2), "2": (1, 1, 0), "3": (1, 1, 1), "4": (1, 1, 1)}


def test_top_performers_break_ties_by_user(spark):
    out = user_jobs.user_analytics(ideas(spark, SEED_IDEAS), votes(spark, SEED_VOTES), comments(spark, SEED_COMMENTS))
    best = user_jobs.top_performers(out, n=2).orderBy("rank").collect()
    assert [(r.user_id, r.rank, r.user_score) for r in best] == [("3", 1, 13), ("4", 2, 13)]


def test_search_is_literal_and_case_blind(spark):
    rows = [("AI bots", "x"), ("Robots", "y"), ("Other", "use ai"), ("100%", "z")]
    table = spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(rows)], "idea_id int, title string, description string")
    found = lambda s: sorted(r.idea_id for r in idea_jobs.search_ideas(table, search=s).collect())
    assert found("AI") == [1, 3]
    assert found("%") == [4]
    assert found("_") == []


def test_listing_refuses_unknown_sort(spark):
    with pytest.raises(ValueError):
        idea_jobs.list_ideas(ideas(spark, SEED_IDEAS), comments(spark, SEED_COMMENTS), sort_by="title")


SERIES = {
    "up": [10, 12, 15, 18, 22, 25, 30, 35, 40, 45, 50, 55, 60, 65],
    "down": [60, 58, 55, 50, 45, 40, 35, 30, 25, 20, 18, 15, 12, 10],
    "flat": [25, 26, 24, 25, 27, 25, 26, 24, 25, 26, 25, 24, 26, 25],
    "one": [3],
    "short": [1, 2],
}


def test_series_trend(spark):
    rows = [(k, i, v) for k, series in SERIES.items() for i, v in enumerate(series)]
    table = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.k: r for r in idea_jobs.series_trend(table, ["k"], "i", "v").collect()}
    assert (got["up"].trend, got["down"].trend, got["flat"].trend) == ("rising", "declining", "stable")
    assert got["up"].growth_rate == pytest.approx(1.651515, abs=1e-6)
    assert got["down"].recent_average == pytest.approx(18.571429, abs=1e-6)
    assert got["flat"].growth_rate == pytest.approx(-0.016854, abs=1e-6)
    assert (got["one"].trend, got["one"].growth_rate) == ("insufficient_data", 0.0)
    assert (got["short"].trend, got["short"].growth_rate, got["short"].recent_average) == ("rising", 1.0, 1.5)


def test_category_averages(spark):
    rows = [("innovation", 25), ("innovation", 30), ("improvement", 15), ("improvement", 20), ("cost_saving", 35)]
    table = spark.createDataFrame([(c, v, 4.0) for c, v in rows], "category string, vote_count int, average_rating double")
    got = {r.category: (r.avg_votes, r.idea_count) for r in idea_jobs.category_averages(table).collect()}
    assert len(got) == 3 and got["innovation"] == (27.5, 2)


def test_view_counts(spark):
    rows = [("i", f"u{n}", "view") for n in range(10)] + [("i", f"u{n}", " View") for n in range(3)]
    table = spark.createDataFrame(rows, "content_id string, user_id string, interaction_type string")
    row = idea_jobs.view_counts(table).first()
    assert (row.view_count, row.unique_viewers) == (13, 10)


def test_mixed_feedback_is_controversial(spark):
    rows = [(1, f"u{i}", "upvote", None) for i in range(15)] + [(1, f"d{i}", "downvote", None) for i in range(12)]
    rows += [(1, "r1", "rating", 2.1), (1, "r2", "rating", 4.8)]
    found = idea_jobs.controversial_ideas(ideas(spark, SEED_IDEAS), votes(spark, rows)).collect()
    assert [r.idea_id for r in found] == [1]


def test_interaction_counts_keep_similar_users_apart(spark):
    rows = [("user_1", "view", T0 + timedelta(seconds=i), i) for i in range(9)]
    rows += [("user_10", "view", T0 + timedelta(seconds=i), 100 + i) for i in range(10)]
    table = spark.createDataFrame(rows, "user_id string, interaction_type string, timestamp timestamp, event_id long")
    assert [(r.user_id, r.total_interactions) for r in user_jobs.milestones(table).collect()] == [("user_10", 10)]


def test_vote_sync(spark):
    rows = [(1, f"u{i}", "upvote", None) for i in range(10)] + [(1, "d", "downvote", None)]
    out = idea_jobs.vote_sync_report(ideas(spark, SEED_IDEAS), votes(spark, rows))
    row = out.where("idea_id = 1").first()
    assert (row.vote_count, row.score) == (11, 0.45)
    assert out.where("idea_id = 2").first().vote_count == 0


def test_table_counts_report_missing(spark):
    got = {r.table_name: (r.found, r.row_count) for r in idea_jobs.table_counts({"a": spark.range(3), "b": None}).collect()}
    assert got == {"a": (True, 3), "b": (False, 0)}


def test_top_k_plans_have_no_global_window_over_all_rows(spark, tables):
    analytics = user_jobs.user_analytics(tables.rated_ideas, tables.votes, tables.comments)
    plan = user_jobs.top_performers(analytics)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scans_are_pruned(spark, tables):
    plan = jobs.vote_counts(tables.votes)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "ip_address" not in schema and "value" not in schema and "PushedFilters: [" in plan


def test_ranks_are_limited_before_the_shuffle(tables):
    from agora.operators import decisions

    for df in (decisions.actor_recent_actions(tables.decision_events), jobs.leaderboard(tables.ideas, tables.votes)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize(
    "name", ["decision_suggestions", "interaction_edges", "metric_alerts_from_table", "clean_metrics", "idea_metrics"]
)
def test_no_cross_joins_and_no_python_in_plans(spark, name):
    from checks import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("sort_by", ["vote_count", "average_rating", "created_at"])
def test_deep_pages_follow_the_order(spark, sort_by, descending):
    """Nulls, ties and repeated ids: every page is that stretch of the whole listing."""
    start = datetime(2024, 1, 1)
    rows = [
        (k % 480, None if k % 7 == 0 else k % 5, None if k % 9 == 0 else float(k % 13), start + timedelta(minutes=k // 3))
        for k in range(500)
    ]
    table = spark.createDataFrame(rows, "idea_id int, vote_count long, average_rating double, created_at timestamp")
    whole = [tuple(r) for r in table.orderBy(*idea_jobs._listing_order(sort_by, descending)).collect()]
    column = table.columns.index(sort_by)
    for offset in (0, 201, 333, 427, 430, 495, 600):
        page = [tuple(r) for r in idea_jobs.page_rows(table, sort_by, descending, offset, 10).collect()]
        key = lambda r: (r[column], r[0])
        assert list(map(key, page)) == list(map(key, whole[offset : offset + 10])), offset


@pytest.mark.parametrize("descending", [True, False])
def test_cursor_walks_the_whole_listing(spark, descending):
    rows = [(k, None if k % 4 == 0 else k % 3) for k in range(40)]
    table = spark.createDataFrame(rows, "idea_id int, vote_count long")
    order = idea_jobs._listing_order("vote_count", descending)
    whole = [tuple(r) for r in table.orderBy(*order).collect()]
    seen = whole[:1]
    while True:
        page = idea_jobs.ideas_after(table, seen[-1][1], seen[-1][0], 9, "vote_count", descending).collect()
        if not page:
            break
        seen += [tuple(r) for r in page]
    assert seen == whole
