import json
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from agora import schemas, session
from agora.sources import kafka, tables


def test_jdbc_options(monkeypatch):
    monkeypatch.setenv("DB_USER", "reader")
    store = tables.JdbcTables("jdbc:postgresql://db/x", {"votes": tables.KeyRange("vote_id", "0", "1000", 16)})
    options = store.read_options("votes")
    assert options["numPartitions"] == "16" and options["partitionColumn"] == "vote_id" and options["fetchsize"] == "1000"
    assert options["user"] == "reader" and "numPartitions" not in store.read_options("ideas")
    assert store.write_options("t")["batchsize"] == "1000" and store.write_options("t")["numPartitions"] == "16"


class LocalTables(tables.JdbcTables):
    """The database's part played by folders; ``fails`` breaks a write after some of its rows."""

    folder, fails = "", False

    def read(self, spark, table):
        return spark.read.parquet(f"{self.folder}/{table}")

    def write(self, df, table, mode="append"):
        if self.fails and not table.endswith("_commits"):
            df.where("id % 2 = 0").write.mode(mode).parquet(f"{self.folder}/{table}")
            raise OSError("connection lost")
        df.write.mode(mode).parquet(f"{self.folder}/{table}")


def test_batches_count_from_their_commit(spark, tmp_path):
    """Parallel writes; a half-failed try doesn't count and can be found; a repeated batch is written once."""
    class Store(LocalTables):
        folder = str(tmp_path)

    class Broken(Store):
        fails = True

    store, rows = Store("jdbc:none"), spark.range(0, 40, 1, 8)
    with pytest.raises(OSError):
        Broken("jdbc:none").write_batch(rows, "votes", "q", 0)
    assert store.read(spark, "votes").count() == 20 and store.abandoned(spark, "votes").count() == 1
    store.write_batch(rows, "votes", "q", 0)
    store.write_batch(rows, "votes", "q", 0)
    store.write_batch(spark.range(3), "votes", "q", 1)
    store.write_batch(spark.range(5), "votes", "other", 0)
    got = {tuple(r)[:2]: r["count"] for r in store.read_committed(spark, "votes").groupBy("query_id", "batch_id").count().collect()}
    assert got == {("q", 0): 40, ("q", 1): 3, ("other", 0): 5}
    assert store.abandoned(spark, "votes").count() == 1
    files = store.read(spark, "votes").where("batch_id = 0 AND query_id = 'q'").select("attempt", F.input_file_name()).distinct()
    assert max(r["count"] for r in files.groupBy("attempt").count().collect()) == 8  # a file for each task
    # Two writers of one batch that both got through: one of them counts.
    again = spark.range(2).withColumns({"query_id": F.lit("q"), "batch_id": F.lit(1).cast("long"), "attempt": F.lit("z")})
    store.write(again, "votes")
    store.write(again.select("query_id", "batch_id", "attempt").limit(1), "votes_commits")
    assert store.read_committed(spark, "votes").where("query_id = 'q' AND batch_id = 1").count() == 3


@pytest.mark.parametrize("split", [None, "k"])
@pytest.mark.parametrize("column", ["n", "s", "d"])
def test_slices_cover_every_row_once(column, split):
    """A third of the rows have one value, some none; the parts are even but for what can't be cut."""
    engine = duckdb.connect()
    engine.execute(
        """CREATE TABLE t AS SELECT i AS k, CASE WHEN i % 20 = 0 THEN NULL WHEN i % 3 = 0 THEN 500 ELSE (i * i) % 6007 END AS n,
                  'it''s ' || n AS s, DATE '2024-01-01' + CAST(n AS INTEGER) AS d FROM range(12000) r(i)"""
    )
    shares = [k / 12 for k in range(1, 12)]
    borders = engine.execute(f"SELECT quantile_disc({column}, {shares}) FROM t").fetchone()[0]
    predicates = tables.slice_predicates(column, borders, split)
    counts = [engine.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in predicates]
    assert sum(counts) == 12_000
    once = " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in predicates)
    assert engine.execute(f"SELECT min({once}), max({once}) FROM t").fetchone() == (1, 1)
    assert max(counts) < (2_000 if split else 4_100)


def test_slices_of_odd_borders():
    assert tables.slice_predicates("c", []) == ["c IS NULL", "c IS NOT NULL"]
    assert tables.slice_predicates("c", [None, date(2024, 1, 2)]) == ["c IS NULL", "c <= '2024-01-02'", "c > '2024-01-02'"]
    assert tables.slice_predicates("c", [3, 3, 1]) == ["c IS NULL", "c <= 1", "c > 1 AND c < 3", "c = 3", "c > 3"]
    query = tables.borders_query("votes", "vote_id", 4)
    assert "ARRAY[0.25, 0.5, 0.75]" in query and "percentile_disc" in query and "FROM votes" in query


def test_topics_are_read_together():
    options = kafka.Broker("a:9092", group="g").read_options("interactions", "thoughts", "metrics", "recommendations")
    assert options["subscribe"] == "interactions,thoughts,metrics,recommendations" and options["kafka.group.id"] == "g"
    assert options["startingOffsets"] == "latest" and options["failOnDataLoss"] == "false"


def test_kafka_options():
    broker = kafka.Broker("a:9092", group="g")
    assert broker.read_options("x", "y", max_per_trigger=100) == {
        "kafka.bootstrap.servers": "a:9092", "subscribe": "x,y", "startingOffsets": "latest", "failOnDataLoss": "false",
        "kafka.group.id": "g", "maxOffsetsPerTrigger": "100",
    }
    written = broker.write_options("t")
    assert written["kafka.acks"] == "all" and written["kafka.enable.idempotence"] == "true" and written["topic"] == "t"


@pytest.mark.parametrize("make", ["files", "catalog"])
def test_table_stores(spark, tmp_path, make):
    store = tables.FileTables(str(tmp_path)) if make == "files" else tables.CatalogTables()
    name = f"numbers_{make}"
    assert not store.exists(spark, name)
    store.write(spark.range(3), name)
    store.write(spark.range(2), name, "append")
    assert store.exists(spark, name) and store.read(spark, name).count() == 5
    store.write(spark.range(1), name, "overwrite")
    assert store.read(spark, name).count() == 1


def test_run_summary(spark, tmp_path):
    store = tables.FileTables(str(tmp_path))
    tables.save_run(spark, store, "daily", {"a": spark.range(2), "b": spark.range(1).withColumn("x", F.lit("y"))}, datetime(2024, 1, 1))
    row = store.read(spark, "analytics_runs").first()
    content = json.loads(row.results_json)
    assert row.status == "completed" and sorted(content) == ["a", "b"] and len(content["a"]) == 2


def test_broken_json_is_kept_apart(spark):
    good = '{"event_id":"1","idea_id":2,"timestamp":"2024-01-01T00:00:00Z","rating":4.5}'
    messages = spark.createDataFrame([(good,), ("{broken",)], "value string")
    rows = kafka.parse(messages, schemas.VOTE_EVENT).collect()
    assert rows[0].idea_id == 2 and rows[0].rating == 4.5 and rows[0]._corrupt is None
    assert rows[1].event_id is None and rows[1]._corrupt == "{broken"
    votes = kafka.parse_votes(messages)
    assert [row.idea_id for row in votes.collect()] == [2]
    assert votes.columns == [*schemas.VOTE_EVENT.names, "processing_time"]
    assert [row.value for row in kafka.dead_votes(messages).collect()] == ["{broken"]


def test_envelope_and_keys(spark):
    table = spark.createDataFrame([("u1", "text here", None, None)], "user_id string, thought_text string, sentiment_score double, tags array<string>")
    topic, messages = kafka.keyed_messages(kafka.thought_events(table), "thought_capture", "producer-1")
    row = messages.first()
    value = json.loads(row.value)
    assert (topic, row.key) == ("thought-captures", "u1")
    assert (value["word_count"], value["tags"], value["version"], value["producer_id"]) == (2, [], "1.0", "producer-1")
    assert len(value["event_id"]) == 36
    parted = kafka.to_messages(table.withColumn("p", F.lit(3)), key="user_id", partition="p")
    assert parted.first().partition == 3


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark).rstrip("/").startswith(("file:", "/"))
    one, two = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert one != two and spark.sparkContext.getConf().get("spark.checkpoint.dir").rsplit("/", 1)[-1] in one


def test_bucketed_tables_join_without_a_shuffle(spark):
    store = tables.CatalogTables(buckets={"b_votes": (4, "idea_id"), "b_ideas": (4, "idea_id")})
    rows = spark.range(1000).select((F.col("id") % 50).cast("int").alias("idea_id"), "id")
    store.write(rows, "b_votes")
    store.write(rows.select("idea_id").distinct(), "b_ideas")
    joined = store.read(spark, "b_votes").hint("merge").join(store.read(spark, "b_ideas"), "idea_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000
