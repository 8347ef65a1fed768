"""Every operator and stage over odd rows and over no rows."""

import pytest

import corpus_pipeline
import public_tokenizers
from agora.llm import binary, decontam, html, langid, linedup, mixing, neardup, quality, tokens, toxicity
from agora.llm.queries import token_digest
from llm_cases import CLASHING, documents, odd_rows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (100, 1), (101, 0), (101, 0)], "doc_id bigint, toxic int")


def _items(spark):
    rows = [(1, "one"), (2, None), (None, "one two"), (3, ""), (4, odd_rows()[0][1])]
    return spark.createDataFrame(rows, "item_id bigint, text string")


OPERATORS = {
    "toxicity": lambda spark, docs: toxicity.toxicity_scores(spark, docs, _labels(spark)),
    "quality": quality.quality_verdicts,
    "tokens": lambda spark, docs: tokens.token_counts(docs, VOCABULARY),
    "lines": linedup.line_duplicates,
    "near": neardup.near_duplicates,
    "mix": lambda spark, docs: mixing.mix(mixing.sized(docs)),
    "language": langid.languages,
    "files": token_digest,
}
COUNTS = {"lines": "ids"}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, name):
    rows = odd_rows()
    found = OPERATORS[name](spark, documents(spark, rows, extra=True)).collect()
    assert len(found) == (len({row[0] for row in rows}) if name == "lines" else len(rows))
    assert {row["doc_id"] for row in found} == {row[0] for row in rows}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, documents(spark, [], extra=True)).count() == 0


def test_leaks_of_odd_rows(spark):
    found = decontam.leaks(spark, documents(spark, odd_rows(), extra=True), _items(spark)).collect()
    assert sorted((row["item_id"], row["doc_id"]) for row in found) == [(1, 9), (1, 10), (4, 1), (4, 2)]
    none = documents(spark, [])
    assert decontam.leaks(spark, none, _items(spark)).count() == 0
    assert decontam.leaks(spark, documents(spark, odd_rows()), _items(spark).limit(0)).count() == 0


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<p>"), (2, "u", "<p>"), (3, "u", "<article><p>" + "word " * 50_000)]
    found = html.extracted(spark.createDataFrame([(*row, 1) for row in rows], "page_id bigint, url string, html string, n_chars int"))
    assert sorted(row["n_chars"] for row in found.collect()) == [0, 0, 0, 0, 249_999]
    assert html.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("rows", [odd_rows(), []], ids=["odd", "none"])
def test_stages(spark, tmp_path, stage, rows):
    _items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, rows, extra=True)
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == docs.columns
    assert {row["doc_id"] for row in found.collect()} <= {row[0] for row in rows}


def test_clashing_columns_are_many():
    assert CLASHING.count(",") > 20


def test_line_filter_of_odd_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows, extra=True)
    found = linedup.without_duplicate_lines(spark, docs)
    assert found.columns == docs.columns
    assert found.count() == len(rows)
    assert binary.read_tokens is not None


def test_line_filter_of_very_many_lines(spark):
    """A text of 60,000 lines, each second one a repetition."""
    text = "\n".join(f"line number {k // 2} of a long text" for k in range(60_000))
    row = linedup.without_duplicate_lines(spark, documents(spark, [(1, text, "en", "s")]), edits=0).first()
    assert row["text"] == "\n".join(f"line number {k} of a long text" for k in range(30_000))
