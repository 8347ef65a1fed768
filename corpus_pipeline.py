"""Corpus pipeline: from raw documents to token files.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns
a frame that is written as Parquet and read again as the next stage's docs. All but the
last return the columns of the documents. What a stage does with nulls, empty texts, repeated
rows and empty tables is what its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm import decontam, mixing, neardup, quality
from agora.llm.common import stored
from agora.llm.queries import token_digest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain limits and the outlier test of their language and source."""
    return quality.quality_filter(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Links hold from 80 % of shared five-word shingles upwards.
    """
    return neardup.without_near_duplicates(spark, docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontam.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; copies are rows."""
    return mixing.mixed_copies(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document in the token files, read back from them."""
    return token_digest(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("source mix", source_mix),
    ("token files", token_files),
]

#: Tokenizing and coding can't be expressed in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stored(spark, stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
