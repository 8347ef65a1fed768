"""The operators, each applied to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from agora.llm import (
    binary,
    decontam,
    html,
    langid,
    linedup,
    mixing,
    neardup,
    negatives,
    oracles,
    pieces,
    quality,
    tokens,
    toxicity,
    whitening,
)
from agora.llm.common import stored
from agora.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the token files of the documents and read them back."""
    files = scratch_path(spark, "token-files")
    binary.write_tokens(docs, files, public_tokenizers.path("byte_bpe_50k.json"))
    return binary.read_tokens(spark, files, with_ids=False)


@_register
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality_verdicts(spark, _table(spark, folder, "documents"))


@_register
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes from every document."""
    rows = mixing.sized(_table(spark, folder, "documents").select("doc_id", "source", "text")).drop("text")
    return mixing.mix(stored(spark, rows, "mix-sizes")).drop("source", "copies")


@_register
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    return tokens.token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_register
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Start, length and checksum of every document, read back from its token files."""
    return token_digest(spark, _table(spark, folder, "documents"))


@_register
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document at 85 % of shared three-word shingles."""
    return neardup.near_duplicates(spark, _table(spark, folder, "documents"), shingle=3, percent=85)


@_register
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item contained in a document."""
    return decontam.leaks(spark, _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_register
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity_scores(spark, _table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_register
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicate lines of every document."""
    return linedup.line_duplicates(spark, _table(spark, folder, "documents"))


@_register
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return langid.languages(spark, _table(spark, folder, "documents"))


@_register
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html.extracted(_table(spark, folder, "pages"))


@_register
def op11_piece_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document under the 32k piece vocabulary, and of their decoded text."""
    return pieces.piece_digests(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_register
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh row has the next label."""
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spark, vectors.select("vec_id", moved.alias("label"), "embedding"))


@_register
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the eight principal components, whitened."""
    found = whitening.whitened(spark, _table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


ORACLES.update(
    op12_hard_negatives=oracles.hard_negatives(),
    op2_quality_rules=oracles.quality_rules(),
    op4_benchmark_decontamination=oracles.leaks(),
    op6_minhash_near_dedup=oracles.near_duplicates(shingle=3, percent=85),
    op7_source_mix=oracles.source_mix(),
)
