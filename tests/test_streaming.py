import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from agora import schemas
from agora.operators import users as user_jobs
from agora.operators import votes as vote_jobs
from agora.sources import kafka
from agora.sources.tables import CatalogTables, FileTables
from agora.streaming import events as reactions
from agora.streaming import sinks, stateful
from agora.streaming import votes as live

T0 = datetime(2024, 1, 1)


def vote(i, user, minute, idea=1, kind="upvote", event="vote_cast", ip="1"):
    return (f"{i:04d}", event, idea, user, kind, None, T0 + timedelta(minutes=minute), ip, "agent")


class Source:
    """A folder of JSON files, one per micro-batch."""

    def __init__(self, spark, folder, schema=schemas.VOTE_EVENT):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        folder.mkdir()

    def add(self, rows):
        self.n += 1
        df = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        text = [r.value for r in kafka.to_messages(df).collect()]
        (self.folder / f"{self.n:03d}.json").write_text("\n".join(text))

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder))


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path / "in")


def run(stream, tmp_path, mode="append", name="out", **kwargs):
    sinks.run_available(sinks.to_files(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp", mode, **kwargs))
    return stream.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_late_votes_are_dropped(source, tmp_path):
    source.add([vote(1, "a", 0), vote(2, "b", 1)])
    source.add([vote(3, "a", 60)])
    # Rows are judged late by the watermark of the batch before.
    source.add([vote(7, "a", 61)])
    source.add([vote(4, "c", 2), vote(5, "d", 55)])
    source.add([vote(6, "a", 200)])
    out = run(live.aggregate_votes(source.stream()), tmp_path)
    got = {r.window_start: r.upvotes for r in out.collect()}
    assert got == {T0: 2, T0 + timedelta(minutes=60): 2, T0 + timedelta(minutes=55): 1}


def test_update_mode_equals_the_batch_function(source, tmp_path, spark):
    for n in range(3):
        source.add([vote(10 * n + i, f"u{i}", n + i, idea=i % 2, kind=("upvote", "downvote")[i % 2]) for i in range(6)])
    out = run(live.aggregate_votes(source.stream()), tmp_path, "update")
    last = out.groupBy("window_start", "idea_id").agg(F.max_by("total_events", "batch_id").alias("n"))
    batch = vote_jobs.votes_per_window(spark.read.schema(schemas.VOTE_EVENT).json(str(source.folder)))
    assert {tuple(r) for r in last.collect()} == {(r.window_start, r.idea_id, r.total_events) for r in batch.collect()}


def test_restart_continues_from_the_checkpoint(source, tmp_path):
    source.add([vote(1, "a", 0), vote(2, "a", 1)])
    stream = source.stream().select("user_id", F.col("timestamp"))
    first = run(stateful.milestones(stream, every=3), tmp_path, "update")
    assert first.count() == 0
    source.add([vote(3, "a", 2)])
    again = run(stateful.milestones(source.stream(), every=3), tmp_path, "update")
    assert [tuple(r)[:2] for r in again.collect()] == [("a", 3)]


@pytest.mark.parametrize("kind", ["files", "catalogue"])
def test_batches_of_queries_and_checkpoints_stay_apart(spark, source, tmp_path, kind):
    """A new checkpoint starts at batch 0 again, as does a second query on the table."""
    name = f"votes_{uuid.uuid4().hex}"
    store = FileTables(str(tmp_path / "store")) if kind == "files" else CatalogTables()
    source.add([vote(1, "a", 0)])
    for checkpoint in ("one", "two", "one"):
        sinks.run_available(sinks.to_table(source.stream(), store, name, f"{tmp_path}/{checkpoint}", "append"))
    rows = store.read(spark, name).collect()
    assert [r.event_id for r in rows] == ["0001"] * 2 and {r.batch_id for r in rows} == {0}
    assert len({r.query_id for r in rows}) == 2


@pytest.mark.parametrize("kind", ["files", "catalogue"])
def test_a_repeated_batch_replaces_its_half(spark, tmp_path, kind):
    name = f"halves_{uuid.uuid4().hex}"
    store = FileTables(str(tmp_path / "store")) if kind == "files" else CatalogTables()
    store.write_batch(spark.range(4), name, "q", 0)
    store.write_batch(spark.range(10), name, "q", 0)
    store.write_batch(spark.range(5), name, "q", 1)
    store.write_batch(spark.range(3), name, "r", 0)
    got = {tuple(r)[:2]: r["count"] for r in store.read(spark, name).groupBy("query_id", "batch_id").count().collect()}
    assert got == {("q", 0): 10, ("q", 1): 5, ("r", 0): 3}


def test_a_failing_store_is_not_a_missing_table(spark, tmp_path):
    (tmp_path / "broken.parquet").mkdir()
    (tmp_path / "broken.parquet" / "part-0.parquet").write_text("no table")
    store = FileTables(str(tmp_path))
    assert not store.exists(spark, "nowhere")
    with pytest.raises(Exception):
        store.exists(spark, "broken")


def test_three_queries_with_their_own_checkpoints(spark, source, tmp_path):
    source.add([vote(i, "bot", 0, idea=i, ip=str(i)) for i in range(25)])
    queries = live.start_vote_files(source.stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    live.await_all(queries)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert read("vote_aggregates").count() == 25
    anomaly = read("vote_anomalies").first()
    assert (anomaly.user_id, anomaly.vote_count, anomaly.unique_ideas, anomaly.unique_ips) == ("bot", 25, 25, 25)
    # Scores decay from 2024 to today, so they are positive but tiny, or zero.
    assert "trending_score" in read("trending_ideas").columns
    assert live.stop_all(spark) == []


def test_failing_sink_ends_the_query(source, tmp_path):
    source.add([vote(1, "a", 0)])

    def fail(batch):
        raise RuntimeError("sink is down")

    with pytest.raises(Exception, match="sink is down"):
        run(source.stream(), tmp_path, shape=fail)


def allowed(times, limit, seconds):
    """The rule, one vote after the other."""
    opened, count, out = None, 0, []
    for t in times:
        if opened is None or t >= opened + timedelta(seconds=seconds):
            opened, count = t, 0
        count += 1
        out.append(count <= limit)
    return out


def judged(rows, limit, seconds=60):
    """Every vote's verdict when the votes of a user are taken in order of time."""
    out = {}
    for user in {r[3] for r in rows}:
        own = sorted((r[6], r[0]) for r in rows if r[3] == user)
        out |= dict(zip([i for _, i in own], allowed([t for t, _ in own], limit, seconds)))
    return out


def test_vote_limit_matches_brute_force(source, tmp_path):
    """Votes come in any order over the batches; each is judged by its own time."""
    minutes = {"a": [0, 0.2, 0.4, 0.9, 1.1, 1.2, 3.0], "b": [0.5, 1.4, 1.6, 2.5, 2.6, 2.7, 2.8], "c": [2.0, 2.0, 2.0, 2.99]}
    rows = [vote(100 * k + i, user, m) for k, (user, ms) in enumerate(minutes.items()) for i, m in enumerate(ms)]
    mixed = sorted(rows, key=lambda r: (r[0][::-1], r[3]))
    for start in range(0, len(mixed), 5):
        source.add(mixed[start : start + 5])
    end = vote(900, "end", 30)
    source.add([end])
    out = run(stateful.limit_votes(source.stream(), limit=2), tmp_path).collect()
    assert {r.event_id: r.is_allowed for r in out} == judged(rows, 2)  # the last vote still waits
    assert len(out) == len(rows) and all(r.timestamp is not None for r in out)


def test_vote_limit_over_a_restart(source, tmp_path):
    """A window open at the stop goes on, late votes are dropped, waiting ones come out later."""
    rows = [vote(1, "a", 0), vote(2, "a", 0.5), vote(3, "b", 11)]
    source.add(rows)
    first = run(stateful.limit_votes(source.stream(), limit=1), tmp_path)
    assert sorted((r.event_id, r.is_allowed) for r in first.collect()) == [("0001", True), ("0002", False)]
    more = [vote(4, "a", 1.5), vote(5, "b", 11.5), vote(6, "end", 60)]
    source.add([vote(7, "a", 0.2), *more])
    again = run(stateful.limit_votes(source.stream(), limit=1), tmp_path)
    verdicts = {r.event_id: r.is_allowed for r in again.collect()}
    assert verdicts == judged(rows + more[:2], 1) and "0007" not in verdicts


def test_vote_limit_leaves_no_state(spark, source, tmp_path):
    source.add([vote(i, f"u{i % 3}", i / 10) for i in range(20)])
    source.add([vote(90, "end", 200)])
    run(stateful.limit_votes(source.stream(), limit=2), tmp_path, name="limit")
    state = lambda kind, **more: (
        spark.read.format("statestore").option("stateVarName", kind).options(**more).load(f"{tmp_path}/limit-cp")
    )
    assert state("window").count() == 0
    assert {r.key.user_id for r in state("waiting", flattenCollectionTypes="true").collect()} == {"end"}


def test_history_equals_a_window(spark, source, tmp_path):
    """The newest records, whatever batch they come in; a repeated event counts once."""
    rows = [vote(i, f"u{i % 2}", (7 * i) % 23) for i in range(30)]
    for start in range(0, 30, 8):
        source.add(rows[start : start + 8] + rows[:1])
    thoughts = source.stream().select("user_id", "event_id", "timestamp", F.lit("neutral").alias("sentiment_category"), F.lit(3).alias("word_count"))
    out = run(stateful.recent_thoughts(thoughts, keep=4), tmp_path, "update")
    last = out.groupBy("user_id", "place").agg(F.max_by("event_id", "batch_id").alias("event_id"))
    wanted = {
        (user, k): r[0] for user in ("u0", "u1") for k, r in enumerate(sorted((r for r in rows if r[3] == user), key=lambda r: (r[6], r[0]), reverse=True)[:4], 1)
    }
    assert {(r.user_id, r.place): r.event_id for r in last.collect()} == wanted


def test_history_is_forgotten(spark, source, tmp_path):
    """Records an hour behind the watermark leave, users without any leave the state."""
    def step():
        thoughts = source.stream().select("user_id", "event_id", "timestamp", F.lit("neutral").alias("sentiment_category"), F.lit(3).alias("word_count"))
        return run(stateful.recent_thoughts(thoughts, keep=5, hours=1), tmp_path, "update")

    source.add([vote(1, "a", 0), vote(2, "a", 50), vote(3, "b", 1)])
    assert step().count() == 3
    source.add([vote(4, "z", 80)])  # the watermark is at minute 70
    source.add([vote(5, "a", 81)])
    assert sorted((r.user_id, r.event_id) for r in step().collect() if r.batch_id > 1) == [("a", "0002"), ("a", "0005"), ("z", "0004")]
    state = spark.read.format("statestore").option("stateVarName", "kept").option("flattenCollectionTypes", "true").load(f"{tmp_path}/out-cp")
    assert {r.key.user_id for r in state.collect()} == {"a", "z"}


RULES = "anomaly_type string, severity string, event string, subject_column string, window_seconds long, threshold long"


def test_rules_on_a_stream(spark, source, tmp_path):
    """Two window lengths in one query; late rows don't count; a row per closed window."""
    rules = spark.createDataFrame(
        [("surge", "Medium", "vote", "idea_id", 600, 3), ("rapid", "High", "vote", "user_id", 20, 2), ("flood", "Low", "comment", "idea_id", 600, 1)], RULES
    )
    rows = [vote(1, "a", 0), vote(2, "a", 0.25), vote(3, "b", 9), vote(4, "b", 10), vote(5, "c", 11, idea=2)]
    source.add(rows)
    source.add([vote(6, "z", 100, idea=9)])
    source.add([vote(10, "z", 100.5, idea=6)])  # rows are judged late by the watermark of the batch before
    source.add([vote(7, "a", 0.1), vote(8, "z", 101, idea=8)])  # the first of these is late
    source.add([vote(9, "z", 300, idea=7)])
    events = source.stream().withColumn("event", F.lit("vote"))
    out = run(live.rule_anomalies(events, rules), tmp_path)
    got = {(r.anomaly_type, r.severity, r.subject, r.window_start, r.event_count) for r in out.collect()}
    assert got == {("surge", "Medium", "1", T0, 3), ("rapid", "High", "a", T0, 2)}
    batch = spark.createDataFrame(rows, schemas.VOTE_EVENT).withColumn("event", F.lit("vote"))
    same = live.rule_anomalies(batch, rules).collect()
    assert {(r.anomaly_type, r.severity, r.subject, r.window_start, r.event_count) for r in same} == got
    with pytest.raises(ValueError, match="rule"):
        live.rule_anomalies(batch, rules.limit(0))


def test_algorithm_performance_on_a_stream(spark, tmp_path):
    folder = tmp_path / "recommendations"
    folder.mkdir()
    schema = "algorithm string, confidence_score double"
    for n, rows in enumerate([[("a", 0.5), ("b", 1.0)], [("a", 0.7), (None, 0.1), ("a", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/part-{n}")
        next((tmp_path / f"part-{n}").glob("*.json")).rename(folder / f"{n}.json")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    out = run(reactions.algorithm_performance(stream), tmp_path, "update", name="performance")
    last = out.groupBy("algorithm").agg(F.max_by(F.struct("recommendations_generated", "average_confidence"), "batch_id").alias("r"))
    got = {r.algorithm: (r.r[0], None if r.r[1] is None else round(r.r[1], 9)) for r in last.collect()}
    assert got == {"a": (3, 0.6), "b": (1, 1.0), None: (1, 0.1)}


def test_vote_life_cycle(source, tmp_path):
    source.add([vote(1, "a", 0), vote(2, "b", 0)])
    source.add([vote(3, "a", 1, kind="downvote", event="vote_updated"), vote(4, "c", 1)])
    source.add([vote(5, "b", 2, event="vote_removed"), vote(0, "a", 0.5)])
    out = run(stateful.vote_changes(source.stream()), tmp_path)
    totals = out.agg(F.sum("upvote_change"), F.sum("downvote_change")).first()
    assert tuple(totals) == (1, 1)
    events = source.spark.read.schema(schemas.VOTE_EVENT).json(str(source.folder))
    row = vote_jobs.net_from_lifecycle(events).first()
    assert (row.upvotes, row.downvotes) == (1, 1)


def test_same_event_twice(source, tmp_path):
    source.add([vote(1, "a", 0), vote(1, "a", 0)])
    source.add([vote(1, "a", 0), vote(2, "a", 1)])
    out = run(reactions.without_repeats(source.stream()), tmp_path)
    assert sorted(r.event_id for r in out.collect()) == ["0001", "0002"]


def test_sessions_close_after_the_gap(spark, tmp_path):
    schema = schemas.EVENT_SCHEMAS["user_interaction"]
    inputs = Source(spark, tmp_path / "in", schema)

    def click(user, minute, kind):
        return {"user_id": user, "timestamp": T0 + timedelta(minutes=minute), "interaction_type": kind}

    inputs.add([click("a", 0, "view"), click("a", 10, "like"), click("a", 100, "view")])
    inputs.add([click("b", 500, "view")])
    out = run(user_jobs.user_sessions(live.in_time(inputs.stream())), tmp_path)
    got = sorted((r.user_id, r.page_views, r.interactions, r.duration_seconds) for r in out.collect())
    assert got == [("a", 1, 1, 0), ("a", 1, 2, 600)]


def test_routing_and_dead_letters(spark):
    values = [
        '{"event_type":"system_metric","metric_name":"cpu_usage","metric_value":81.0,"component":"x"}',
        '{"event_type":"thought_capture","user_id":"u","thought_text":"a b","sentiment_score":-0.8}',
        '{"event_type":"mystery"}',
        "no json",
    ]
    messages = spark.createDataFrame([("t", v) for v in values], "topic string, value string")
    assert reactions.metric_alerts(reactions.route(messages, "system_metric")).count() == 1
    thoughts = reactions.route(messages, "thought_capture")
    assert reactions.wellness_alerts(thoughts).count() == 1
    assert reactions.thought_history(thoughts).first().word_count == 2
    assert reactions.unrouted(messages).count() == 2
    counters = {r.event_type: (r.processed, r.errors) for r in reactions.event_counters(messages).collect()}
    assert counters["mystery"] == (1, 0) and counters[None] == (1, 1)


def test_missing_sentiment_is_filled(spark):
    rows = [("great and helpful", None), ("risky", None), ("neither", None), ("great", -0.5)]
    table = spark.createDataFrame(rows, "thought_text string, sentiment_score double")
    got = [r.sentiment_score for r in reactions.with_sentiment(table).collect()]
    assert got == [1.0, -1.0, None, -0.5]


def test_writers_carry_their_options(spark, source, tmp_path):
    source.add([vote(1, "a", 0)])
    writer = reactions.in_small_batches(sinks.to_console(source.stream(), "append"), 5)
    assert writer is not None
    with pytest.raises(Exception, match="kafka"):
        kafka.Broker("localhost:9092").writer(source.stream(), "t", str(tmp_path / "cp"), "append").start()
