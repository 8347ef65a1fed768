import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agora.operators import quality
from agora.plans import etl
from agora.sources import files

T0 = datetime(2024, 1, 1)


def broken(spark, rules, schema, good, **bad):
    """Fields of the rules broken by ``good`` with some values replaced."""
    names = [part.split()[0] for part in schema.split(", ")]
    row = tuple({**good, **bad}.get(n) for n in names)
    checked = quality.with_errors(spark.createDataFrame([row], schema), rules).first()
    return [(e.field, e.error_type) for e in checked.errors]


VOTE = "idea_id int, vote_type string, rating double"


@pytest.mark.parametrize(
    "bad, expected",
    [
        ({}, []),
        ({"rating": 6.0, "vote_type": "rating"}, [("rating", "range")]),
        ({"rating": 0.5, "vote_type": "rating"}, [("rating", "range")]),
        ({"vote_type": "rating"}, [("rating", "missing")]),
        ({"rating": 3.0}, [("rating", "forbidden")]),
        ({"vote_type": "other"}, [("vote_type", "choice")]),
        ({"vote_type": None}, [("vote_type", "choice")]),
        ({"idea_id": None}, [("idea_id", "range")]),
        ({"idea_id": 0}, [("idea_id", "range")]),
    ],
)
def test_vote_rules(spark, bad, expected):
    assert broken(spark, quality.vote_rules(), VOTE, {"idea_id": 1, "vote_type": "upvote"}, **bad) == expected


THOUGHT = "user_id string, thought_text string, sentiment_score double, tags array<string>"


@pytest.mark.parametrize(
    "bad, expected",
    [
        ({}, []),
        ({"thought_text": ""}, [("thought_text", "length"), ("thought_text", "blank")]),
        ({"thought_text": "   "}, [("thought_text", "blank")]),
        ({"thought_text": "x" * 10001}, [("thought_text", "length")]),
        ({"thought_text": "x" * 10000}, []),
        ({"thought_text": None}, [("thought_text", "length")]),
        ({"sentiment_score": -1.1}, [("sentiment_score", "range")]),
        ({"tags": ["t"] * 21}, [("tags", "size")]),
        ({"tags": []}, []),
        ({"user_id": ""}, [("user_id", "empty")]),
    ],
)
def test_thought_rules(spark, bad, expected):
    good = {"user_id": "u", "thought_text": "fine", "sentiment_score": 0.5, "tags": ["a"]}
    assert broken(spark, quality.thought_rules(), THOUGHT, good, **bad) == expected


@pytest.mark.parametrize(
    "bad, expected",
    [
        ({}, []),
        ({"user_id": "a b"}, [("user_id", "format")]),
        ({"user_id": "x" * 101}, [("user_id", "length")]),
        ({"email": "nobody"}, [("email", "format")]),
        ({"email": ""}, []),
    ],
)
def test_user_rules(spark, bad, expected):
    assert broken(spark, quality.user_rules(), "user_id string, email string", {"user_id": "u_1", "email": "a@b.org"}, **bad) == expected


@pytest.mark.parametrize(
    "bad, expected",
    [
        ({}, []),
        ({"title": "Tiny"}, [("title", "length")]),
        ({"title": None}, [("title", "length")]),
        ({"description": "short"}, [("description", "length")]),
        ({"category": "unknown"}, [("category", "choice")]),
        ({"tags": ["t"] * 11}, [("tags", "size")]),
    ],
)
def test_idea_rules(spark, bad, expected):
    good = {"title": "A good title", "description": "d" * 20, "category": "other", "tags": []}
    schema = "title string, description string, category string, tags array<string>"
    assert broken(spark, quality.idea_rules(), schema, good, **bad) == expected


def test_analytics_row(spark):
    schema = "idea_id int, title string, created_at timestamp, vote_count int, average_rating double"
    row = spark.createDataFrame([(124, "AB", None, -5, 6.0)], schema)
    errors = quality.with_errors(row, quality.analytics_rules()).first().errors
    assert sorted((e.field, e.severity) for e in errors) == [
        ("average_rating", "error"), ("created_at", "error"), ("title", "warning"), ("vote_count", "error"),
    ]


def test_split_of_a_batch(spark):
    rows = [("user_1", "view"), ("user_2", "like"), ("", "invalid")]
    table = spark.createDataFrame(rows, "user_id string, interaction_type string").withColumns(
        {"device_type": F.lit("unknown"), "ip_address": F.lit(None).cast("string"), "duration_ms": F.lit(5)}
    )
    good, bad = quality.valid_events(table, "user_interaction")
    assert good.count() == 2 and bad.select("user_id").distinct().count() == 1 and bad.count() == 2
    with pytest.raises(ValueError):
        quality.valid_events(table, "nothing")


def test_gate(spark):
    rows = [("ideas", 0.96, 0.99), ("votes", 0.91, 0.995), ("incomplete", 0.79, 0.96), ("corrupt", 0.96, 0.84)]
    table = spark.createDataFrame(rows, "d string, completeness_score double, accuracy_score double")
    got = {r.d: r.result for r in quality.quality_gate(table).collect()}
    assert got == {"ideas": "succeed", "votes": "succeed", "incomplete": "fail_with_warnings", "corrupt": "fail_data_quality"}


def test_dataset_with_a_missing_column_fails(spark):
    row = quality.validate_dataset(spark.createDataFrame([("u", T0)], "user_id string, timestamp timestamp"), "interactions", T0).first()
    assert not row.passed and row.issues == ["missing column interaction_type"]


def test_ten_percent_nulls_are_tolerated(spark):
    def run(nulls):
        rows = [(None if i < nulls else "u", T0, "view") for i in range(20)]
        return quality.validate_dataset(spark.createDataFrame(rows, "user_id string, timestamp timestamp, interaction_type string"), "interactions", T0).first()

    assert run(2).passed and run(2).null_user_id_percent == 10.0
    assert not run(3).passed


def metric_rows():
    rng = np.random.default_rng(5)
    rows = [("CPU Usage", float(v), T0 + timedelta(seconds=i), "a") for i, v in enumerate(rng.normal(50, 1, 40))]
    rows[20] = ("CPU Usage", 500.0, rows[20][2], "a")
    rows += [("flat", 1.0, T0 + timedelta(seconds=i), "b") for i in range(4)]
    return rows


def test_metrics_match_pandas(spark):
    rows = metric_rows()
    out = etl.transform_metrics(spark.createDataFrame(rows, "metric_name string, metric_value double, timestamp timestamp, component string"))
    got = {(r.metric_name, r.timestamp): r for r in out.collect()}
    frame = pd.DataFrame(rows, columns=["m", "v", "t", "c"])
    for name, part in frame.groupby("m"):
        part = part.sort_values("t")
        means = part["v"].rolling(5).mean()
        odd = (part["v"] - part["v"].mean()).abs() > 3 * part["v"].std()
        for t, mean, flag in zip(part["t"], means, odd):
            row = got[(name.lower().replace(" ", "_"), t.to_pydatetime())]
            assert row.is_anomaly == flag
            assert row.metric_value_ma_5 == (None if np.isnan(mean) else pytest.approx(mean))
    assert sum(r.is_anomaly for r in got.values()) == 1
    assert all(r.metric_value_ma_15 is None for r in got.values() if r.metric_name == "flat")


def write_inputs(spark, folder):
    interactions = [(f"u{i % 7}", T0 + timedelta(minutes=i), " View ", T0, T0 + timedelta(seconds=i % 50), 1.0 * (i % 9)) for i in range(10_050)]
    spark.createDataFrame(
        interactions, "user_id string, timestamp timestamp, interaction_type string, session_start timestamp, session_end timestamp, engagement_score double"
    ).write.parquet(f"{folder}/interactions.parquet")
    thoughts = [{"user_id": "u", "thought_text": "Hello   world", "timestamp": "2024-01-01T10:00:00Z", "sentiment_score": 2.0,
                 "tags": ["personal"], "metadata": {"source": "app", "language": "en"}}]
    with open(f"{folder}/thoughts.json", "w") as out:
        out.writelines(json.dumps(t) + "\n" for t in thoughts)
    spark.createDataFrame(metric_rows(), "metric_name string, metric_value double, timestamp timestamp, component string").drop(
        "component"
    ).withColumn("component", F.lit("x")).write.parquet(f"{folder}/metrics.parquet")


def test_whole_run(spark, tmp_path):
    write_inputs(spark, tmp_path)
    target = str(tmp_path / "out")
    paths = [f"{tmp_path}/{n}" for n in ("interactions.parquet", "thoughts.json", "metrics.parquet", "other.csv", "missing_metrics.parquet")]
    result = etl.run_etl(spark, paths, target, datetime(2024, 2, 1))
    assert not result.success and result.datasets_loaded == 3
    assert result.records_processed >= result.records_written == 10_050 + 1 + 44
    assert set(result.not_read) == {paths[3], paths[4]}
    stored = spark.read.parquet(f"{target}/interactions.parquet")
    assert stored.count() == 10_050 and "date" in stored.columns
    assert {r.interaction_type for r in stored.select("interaction_type").distinct().collect()} == {"view"}
    thought = spark.read.parquet(f"{target}/thoughts.parquet").first()
    assert (thought.thought_text, thought.sentiment_score, thought.has_personal_tag, thought.source) == ("Hello world", 1.0, True, "app")
    assert "date" in spark.read.parquet(f"{target}/metrics.parquet").columns
    record = etl.run_row(spark, result, "etl", T0, T0 + timedelta(seconds=5)).first()
    assert (record.status, record.processing_time_seconds) == ("failed", 5.0)
    assert (record.output_records, len(record.errors)) == (10_095, 2)


def test_a_broken_source_and_equal_names(spark, tmp_path):
    """Two months of one name, one source without its timestamp, and a suffix apart."""
    schema = "user_id string, timestamp timestamp, interaction_type string"
    for month, n in (("month1", 10), ("month2", 20)):
        rows = [(f"u{k}", T0 + timedelta(minutes=k), "view") for k in range(n)]
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{month}/interactions.parquet")
    spark.createDataFrame([("u", "view")], "user_id string, interaction_type string").write.parquet(f"{tmp_path}/broken_interactions.parquet")
    paths = [f"{tmp_path}/{n}" for n in ("month1/interactions.parquet", "month2/interactions.parquet", "broken_interactions.parquet")]
    result = etl.run_etl(spark, paths, str(tmp_path / "out"), T0 + timedelta(days=9))
    assert (result.records_processed, result.records_written, result.datasets_loaded) == (31, 30, 2)
    assert list(result.not_transformed) == [paths[2]] and "timestamp" in result.not_transformed[paths[2]]
    assert [spark.read.parquet(f"{tmp_path}/out/{m}/interactions.parquet").count() for m in ("month1", "month2")] == [10, 20]
    assert set(etl.target_names(["/a/x_metrics.csv", "/a/x_metrics.json"]).values()) == {"x_metrics_csv", "x_metrics_json"}
    with pytest.raises(ValueError):
        etl.run_etl(spark, paths, str(tmp_path / "o"), T0, etl.EtlConfig(enable_deduplication=True))


def test_failed_dataset_is_not_loaded(spark, tmp_path):
    result = etl.run_etl(spark, [f"{tmp_path}/thoughts.txt"], str(tmp_path / "o"), T0)
    assert result.datasets_loaded == 0 and len(result.not_read) == 1
    rows = [(None, T0, "view") for _ in range(5)]
    spark.createDataFrame(rows, "user_id string, timestamp timestamp, interaction_type string").write.parquet(f"{tmp_path}/bad_interactions.parquet")
    result = etl.run_etl(spark, [f"{tmp_path}/bad_interactions.parquet"], str(tmp_path / "p"), T0)
    assert (result.validation_failures, result.datasets_loaded) == (1, 0)


def test_readers(spark, tmp_path):
    with open(tmp_path / "ideas.csv", "w") as out:
        out.write("idea_id,title,vote_count,created_at\n1,A,25,2023-05-01T00:00:00Z\n2,B,15,2023-05-02T00:00:00Z\n3,C,30,\n")
    table = files.read_interactions(spark, str(tmp_path / "ideas.csv"), schema=None)
    scores = table.select((F.col("vote_count").cast("int") / 100).alias("s")).collect()
    assert [r.s for r in scores] == [0.25, 0.15, 0.3]
    with pytest.raises(ValueError):
        files.read_interactions(spark, "x.avro")
    nested = spark.createDataFrame([(1, (2, 3))], "a int, m struct<a: int, b: int>")
    assert files.flatten(nested, "m").columns == ["a", "m_a", "b"]
    assert files.with_partitions(spark.range(1000).toDF("i"), 4, 2).rdd.getNumPartitions() == 2


def test_bulk_import_keeps_timestamps(spark, tmp_path):
    with open(tmp_path / "bulk.csv", "w") as out:
        out.write("title,idea_id,vote_count,tags,created_at\nOne,1,5,a;b,2022-03-04T05:06:07Z\nTwo,x,,,bad\n")
    one, two = files.read_ideas_csv(spark, str(tmp_path / "bulk.csv")).collect()
    assert (one.idea_id, one.title, one.tags, one.created_at) == (1, "One", ["a", "b"], datetime(2022, 3, 4, 5, 6, 7))
    assert (two.idea_id, two.vote_count, two.created_at) == (None, None, None)


def test_switches(spark, tmp_path):
    rows = [("u", T0, "view", 1), ("u", T0, "view", 2), (None, T0, "view", 3)]
    spark.createDataFrame(rows, "user_id string, timestamp timestamp, interaction_type string, n int").write.parquet(
        f"{tmp_path}/interactions.parquet"
    )
    run = lambda name, **kw: etl.run_etl(spark, [f"{tmp_path}/interactions.parquet"], str(tmp_path / name), "2024-02-01 00:00:00", etl.EtlConfig(**kw))
    assert run("a").validation_failures == 1
    assert run("b", enable_validation=False).datasets_loaded == 1
    once = run("c", enable_validation=False, enable_deduplication=True, deduplicate_on=("user_id", "timestamp"))
    assert (once.records_processed, once.records_written) == (3, 2)


def test_submissions_have_few_attachments(spark):
    rows = [(1, "title one", "a description that is long enough", "technology", ["t"], ["f"] * n) for n in (5, 6)]
    table = spark.createDataFrame(rows, "idea_id int, title string, description string, category string, tags array<string>, attachments array<string>")
    broken = {r.field: r.broken_rows for r in quality.rule_counts(table, quality.submission_rules()).collect()}
    assert broken["attachments"] == 1 and broken["tags"] == 0


def test_newest_ties_and_missing_times(spark):
    rows = [("a", None, 1), ("b", None, 2), ("b", T0, 3), ("c", T0, 4), ("c", T0, 5)]
    table = spark.createDataFrame(rows, "k string, t timestamp, v int")
    got = quality.deduplicate(table, ["k"], "t")
    assert {r.k: r.v for r in got.collect()} == {"a": 1, "b": 3, "c": 5} and got.columns == table.columns
