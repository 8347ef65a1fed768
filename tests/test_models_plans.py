import heapq
import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from agora.ml import features, selection, success, topics, wordvectors
from agora.operators import ideas as idea_jobs
from agora.plans import batch, daily, models
from agora.sources.adapter import AS_OF
from agora.sources.tables import FileTables

THEMES = {
    "cost_saving": "energy office lights saving heating bill",
    "innovation": "robot automation learning machine assistant code",
}


@pytest.fixture(scope="module")
def metrics(spark):
    """Eighty ideas on two themes; innovation is implemented, cost saving is not."""
    rows = []
    for i in range(80):
        category = list(THEMES)[i % 2]
        words = THEMES[category].split()
        body = " ".join(words[(i + j) % len(words)] for j in range(12))
        status = "implemented" if category == "innovation" else "draft"
        rows.append((i, f"The {words[i % 6]}?", body, category, status, float(i % 5), i % 30, i % 7, 3.0, i, i % 3))
    return spark.createDataFrame(
        rows,
        "idea_id int, title string, description string, category string, status string, engagement_score double,"
        " days_since_created int, vote_count int, average_rating double, view_count int, comment_count int",
    ).withColumn("created_at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,idea_id % 28)")).cache()


def test_tokens_have_no_stop_words(spark):
    row = spark.createDataFrame([("The Office", "and a plan")], "title string, description string")
    assert features.tokens(row).first().filtered_words == ["office", "plan"]


def test_clusters_follow_the_themes(metrics, tmp_path):
    found = topics.cluster_ideas(metrics, k=2, path=str(tmp_path / "m"))
    assert found.assignments.count() == 80
    purity = found.assignments.groupBy("cluster_id").agg(F.count_distinct("category").alias("n")).collect()
    assert len(purity) == 2 and all(r.n == 1 for r in purity)
    assert -1 <= found.silhouette <= 1 and sum(r.idea_count for r in found.sizes.collect()) == 80
    profile = topics.cluster_profile(found.assignments, metrics)
    assert sum(r.idea_count for r in profile.collect()) == 80
    again = topics.cluster_ideas(metrics, k=2)
    assert again.silhouette == pytest.approx(found.silhouette, abs=0.1)


def test_cluster_terms(metrics):
    found = topics.cluster_topics(metrics, k=2, top_terms=3)
    terms = found.terms.collect()
    assert len(terms) == 6 and {r.rank for r in terms} == {1, 2, 3}
    vocabulary = set(" ".join(THEMES.values()).split())
    assert {r.term for r in terms} <= vocabulary


def test_topics_are_mixtures(metrics):
    found = topics.model_topics(metrics, k=3, iterations=5)
    for row in found.mixtures.collect():
        assert len(row.topic_distribution) == 3 and sum(row.topic_distribution) == pytest.approx(1)
    assert found.terms.groupBy("topic").count().count() == 3
    shares = topics.topic_trend(found.mixtures, metrics).groupBy("period").agg(F.sum("topic_share").alias("s"))
    assert all(r.s == pytest.approx(1) for r in shares.collect())


def test_split_does_not_depend_on_partitions(metrics):
    pick = lambda df: {r.idea_id for r in df.where(features.in_training_set()).collect()}
    one = pick(metrics)
    assert one == pick(metrics.repartition(7)) and 50 <= len(one) <= 75


def test_success_model_learns_saves_and_predicts(spark, metrics, tmp_path):
    path = str(tmp_path / "model")
    trained = success.train_success(metrics, trees=20, path=path)
    assert trained.accuracy > 0.9 and trained.auc > 0.9
    assert max(trained.importances, key=trained.importances.get) == "category_encoded"
    unlabelled = metrics.drop("status", "engagement_score").withColumn(
        "category", F.when(F.col("idea_id") == 3, "never seen").otherwise(F.col("category"))
    )
    rows = success.predict_success(unlabelled, path).collect()
    assert len(rows) == 80 and all(0 <= r.success_probability <= 1 for r in rows)
    assert {r.success_likelihood for r in rows} <= {"High", "Medium", "Low"}
    record = trained.metrics(spark).first()
    assert record.model_name == "idea_success" and "title_length" in record.feature_importance
    assert all(0 <= record[name] <= 1 for name in ("accuracy", "precision", "recall", "f1_score"))
    assert {"numTrees", "maxDepth", "seed"} <= set(record.hyperparameters)


def test_one_class_has_no_auc(tables):
    trained = success.train_popularity(tables.ideas, tables.votes)
    assert trained.auc is None or 0 <= trained.auc <= 1
    assert trained.predictions.count() > 0


@pytest.fixture(scope="module")
def store(spark, tables, tmp_path_factory):
    out = FileTables(str(tmp_path_factory.mktemp("store")))
    out.write(tables.rated_ideas, "ideas")
    out.write(tables.votes, "votes")
    out.write(tables.comments, "comments")
    return out


def test_batch_jobs_write_four_tables(spark, store, tables):
    names = batch.run_batch_jobs(spark, store, AS_OF)
    assert [store.exists(spark, n) for n in names] == [True] * 4
    assert store.read(spark, "idea_metrics_batch").count() == tables.ideas.count()
    ranks = [r["rank"] for r in store.read(spark, "top_performers_batch").orderBy("rank").collect()]
    assert ranks == list(range(1, 101))


def test_daily_run_stores_a_summary(spark, store):
    reports = daily.run_daily(spark, store, datetime(2024, 1, 31))
    row = store.read(spark, "analytics_runs").first()
    assert row.job_type == "daily_analytics" and row.status == "completed"
    assert {"peak_hours", "cluster_topics", "model_metrics"} <= set(reports)


def test_model_run_writes_three_tables(spark, store, tmp_path):
    batch.run_batch_jobs(spark, store, AS_OF)
    figures = models.run_models(spark, store, str(tmp_path / "models"), clusters=3, k_topics=2)
    assert 0 <= figures["accuracy"] <= 1
    for name in ("idea_clusters", "idea_topics", "idea_success_predictions"):
        assert store.exists(spark, name)


def test_weekly_report_parts(tables):
    report = batch.weekly_report(tables.rated_ideas, tables.votes, tables.comments, AS_OF)
    assert set(report) == {"weekly_trend", "top_ideas", "active_users_count", "category_insights"}
    assert report["top_ideas"].count() == 10


def test_lookback_limits_votes_only(tables):
    week = idea_jobs.idea_metrics(tables.rated_ideas, tables.votes, tables.comments, AS_OF, lookback_days=7)
    assert week.count() == tables.ideas.count()


def test_forests_after_an_observation(spark, metrics):
    """What another job observed in the session doesn't reach the fitted model."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    metrics.observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 80
    trained = success.train_success(metrics, trees=3)
    assert not trained.model.stages[-1].hasSummary
    assert success.predict_success(metrics, trained.model).count() == 80


def test_training_after_an_etl_run(spark, tables, metrics, tmp_path):
    from agora.plans import etl

    rows = "u1,2024-01-31 10:00:00,view\nu2,2024-01-31 11:00:00,like\n"
    (tmp_path / "interactions.csv").write_text("user_id,timestamp,interaction_type\n" + rows)
    result = etl.run_etl(spark, [f"{tmp_path}/interactions.csv"], str(tmp_path / "out"), datetime(2024, 2, 1))
    assert result.success and result.records_written == 2
    assert success.train_popularity(tables.ideas, tables.votes).predictions.count() > 0
    trained = success.train_success(metrics, trees=3)
    assert success.predict_success(metrics, trained.model).count() == 80


def test_selection_is_repeatable(metrics):
    """The same folds, figures and model, however the rows lie; the record names the best settings."""
    grid = {"numTrees": (2, 4), "maxDepth": (1, 3)}
    first, again = (selection.select_success_model(rows, "forest", grid) for rows in (metrics.coalesce(1), metrics.repartition(5)))
    assert first.settings == again.settings and first.metric == again.metric
    table = first.record.collect()
    assert len(table) == 4 and [r.is_best for r in table].count(True) == 1
    best = next(r for r in table if r.is_best)
    assert best.metric == max(r.metric for r in table) == first.metric
    assert json.loads(best.settings) == first.settings
    assert first.model.stages[-1].getNumTrees == first.settings["numTrees"]
    scores = [s.select("idea_id", "probability").orderBy("idea_id").collect() for s in (selection.held_out_scores(metrics, m.model) for m in (first, again))]
    assert scores[0] == scores[1] and len(scores[0]) > 5
    with pytest.raises(ValueError, match="kind"):
        selection.select_success_model(metrics, "other")


def test_folds_share_no_idea(spark):
    folds = spark.range(3000).groupBy(selection.fold_of("id", 5).alias("f")).count().collect()
    assert {r.f for r in folds} == set(range(5)) and min(r["count"] for r in folds) > 500


def test_logistic_model_is_calibrated(spark):
    """Probabilities known beforehand come back; the deciles are those of a plain computation."""
    rows = [(k, "t", "c", k % 50, 3, k % 7) for k in range(4000)]
    frame = spark.createDataFrame(rows, "idea_id int, title string, category string, days_since_created int, title_length int, description_length int")
    chance = 1 / (1 + F.exp(-(F.col("days_since_created") - 25) / 6))
    frame = frame.withColumn("is_successful", (F.rand(3) < chance).cast("double")).persist()
    model = success.without_summary(Pipeline(stages=selection.success_stages(selection.estimator_of("logistic"))).fit(frame))
    assert not model.stages[-1].hasSummary
    scored = model.transform(frame).select("is_successful", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    bins = selection.reliability(scored, "p", "is_successful")
    plain = {}
    for r in scored.collect():
        plain.setdefault(min(int(r.p * 10), 9), []).append((r.p, r.is_successful))
    for r in bins.collect():
        own = plain.pop(r.bin)
        assert r.predictions == len(own)
        assert r.mean_predicted == pytest.approx(sum(p for p, _ in own) / len(own))
        assert r.observed == pytest.approx(sum(y for _, y in own) / len(own))
    assert not plain
    assert spark.range(1).select(selection.calibration_error(bins)).first()[0] < 0.05


def test_reliability_of_odd_predictions(spark):
    rows = [(None, 1), (0.5, None), (-0.2, 0), (1.4, 1), (1.0, 0), (0.05, 1)]
    found = selection.reliability(spark.createDataFrame(rows, "p double, y int"), "p", "y").orderBy("bin").collect()
    assert [(r.bin, r.predictions, r.observed) for r in found] == [(0, 2, 0.5), (9, 2, 0.5)]


def test_cluster_hierarchy(metrics):
    """Each level parts the clusters of the level above; the themes are apart at the first level."""
    found = topics.cluster_hierarchy(metrics, levels=2)
    rows = found.assignments.join(metrics.select("idea_id", "category"), "idea_id").collect()
    assert len(rows) == 80
    assert len({(r.level_1, r.category) for r in rows}) == 2
    assert len({(r.level_1, r.level_2) for r in rows}) == len({r.level_2 for r in rows})
    sizes = found.sizes.collect()
    for level in (1, 2):
        assert sum(r.idea_count for r in sizes if r.level == level) == 80
    assert all(r.shared == r.idea_count for r in sizes)
    assert set(found.silhouettes) == {1, 2} and all(-1 <= s <= 1 for s in found.silhouettes.values())
    with pytest.raises(ValueError):
        topics.cluster_hierarchy(metrics, levels=0)


@pytest.fixture
def rare_words(spark):
    """Ideas of which each has fifty words of its own."""
    rows = [(k, f"Idea {k}", " ".join(["energy office" if k % 2 else "robot code"] + [f"w{k}x{j}" for j in range(50)])) for k in range(80)]
    frame = spark.createDataFrame(rows, "idea_id int, title string, description string")
    numbers = {name: F.lit(1.0) * (F.col("idea_id") % 5) for name in features.NUMBERS}
    return frame.withColumns({"category": F.lit("innovation"), **numbers})


def test_clusters_do_not_gather_the_vocabulary(spark, rare_words):
    """Four thousand words have 1.6 MB of vectors; the driver takes 1 MB from a job's tasks."""
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "1m")
    # So small a table would be broadcast; a large one is not.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = topics.cluster_ideas(rare_words, k=2)
        assert found.assignments.count() == 80
    finally:
        conf.remove("spark.driver.maxResultSize")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Every word counts, also one that occurs once.
    vectors = next(s for s in found.model.stages if isinstance(s, wordvectors.WordVectorsModel)).getVectors()
    assert vectors.where("word like 'w%x%'").count() == 4000


def test_huffman_tree_by_runs():
    """The same weight as a plain Huffman tree, a path of its own for every word, also if words of one count lie in two runs."""
    random = np.random.default_rng(3)
    for words in (1, 2, 3, 10, 57):
        counts = np.sort(random.integers(1, 9, words))[::-1]
        cuts = np.flatnonzero(np.append(True, (counts[1:] != counts[:-1]) | (random.random(words - 1) < 0.2)))
        sizes = np.diff(np.append(cuts, words))
        tree = wordvectors.huffman(1000 + 7 * np.arange(len(cuts)) * words, counts[cuts], sizes)
        assert tree.leaf(1000 + 7 * np.repeat(np.arange(len(cuts)), sizes) * words + np.arange(words) - np.repeat(cuts, sizes)).tolist() == list(range(words))
        paths = wordvectors.paths_of(tree, np.arange(words), np.full(words, 2))
        codes = [tuple(zip(*(x[paths.starts[k] : paths.starts[k + 1]].tolist() for x in (paths.nodes, paths.left)), strict=True)) for k in range(words)]
        assert len(set(codes)) == words and paths.size == words - 1
        heap, weight = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            weight += both
            heapq.heappush(heap, both)
        assert sum(len(c) * n for c, n in zip(codes, counts, strict=True)) == weight


def test_paths_leave_out_what_moves_nothing():
    """Nodes over one place of a part are left out; the others keep their order and sides."""
    tree = wordvectors.huffman(np.array([0]), np.array([1]), np.array([8]))
    whole = wordvectors.paths_of(tree, np.arange(8), np.ones(8))
    assert np.diff(whole.starts).tolist() == [3] * 8 and whole.size == 7
    some = wordvectors.paths_of(tree, np.array([0, 1, 7]), np.array([1, 1, 1]))
    assert np.diff(some.starts).tolist() == [3, 3, 1] and some.size == 3
    often = wordvectors.paths_of(tree, np.array([0, 7]), np.array([1, 2]))
    assert np.diff(often.starts).tolist() == [1, 3]


def test_word_vectors_and_means(spark, metrics, tmp_path, monkeypatch):
    """Words of a theme lie together; means are those of a plain computation, in batches and parts of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        words = features.tokens(metrics).select("idea_id", F.flatten(F.array_repeat("filtered_words", 20)).alias("filtered_words"))
        one = wordvectors.WordVectors(inputCol="filtered_words", outputCol="mean", vectorSize=20, minCount=1, numPartitions=4, seed=1)
        first, again = (one.fit(words.repartition(n)).getVectors() for n in (2, 5))
        plain = {r.word: np.array(r.vector) for r in first.collect()}
        assert plain.keys() == {w for r in words.collect() for w in r.filtered_words}
        assert all((plain[r.word] == np.array(r.vector)).all() for r in again.collect())
        monkeypatch.setattr(wordvectors, "PART_WORDS", 9000)
        model = one.fit(words)
        model.write().save(str(tmp_path / "vectors"))
        loaded = wordvectors.WordVectorsModel.load(str(tmp_path / "vectors"))
        plain = {r.word: np.array(r.vector) for r in loaded.getVectors().collect()}
        themes = [[w for w in theme.split() if w in plain] for theme in THEMES.values()]
        near = [np.mean([[plain[a] @ plain[b] / np.linalg.norm(plain[a]) / np.linalg.norm(plain[b]) for a in x] for b in y]) for x, y in ((themes[0], themes[0]), (themes[1], themes[1]), themes)]
        assert min(near[:2]) > near[2] + 0.3
        odd = [(1, ["energy", "unheard", "energy"]), (2, []), (3, None), (4, ["unheard"]), (5, ["energy", "unheard", "energy"]), (6, ["robot"])]
        odd += [(k, themes[0] + themes[1][: k % 3]) for k in range(7, 40)]
        rows = loaded.transform(spark.createDataFrame(odd, "id int, filtered_words array<string>").repartition(3)).collect()
        assert sorted(r.id for r in rows) == [k for k, _ in odd]
        for r in rows:
            known = [plain[w] for w in r.filtered_words or () if w in plain]
            expected = np.sum(known, axis=0) / len(r.filtered_words) if known else np.zeros(20)
            assert r["mean"].toArray() == pytest.approx(expected, abs=1e-6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_word_vectors_of_few_words(spark):
    """A word without neighbours keeps its first vector; rarer words than asked for have none; no word at all is an error."""
    rows = spark.createDataFrame([(["a", "a", "b"],), (["c"],), (["c"],), ([],), (None,)], "words array<string>")
    fit = lambda least: wordvectors.WordVectors(inputCol="words", outputCol="v", vectorSize=4, minCount=least).fit(rows)
    found = {r.word: np.array(r.vector) for r in fit(1).getVectors().collect()}
    assert found.keys() == {"a", "b", "c"} and 0 < np.abs(found["c"]).max() <= 0.125
    assert {r.word for r in fit(2).getVectors().collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        fit(3)
