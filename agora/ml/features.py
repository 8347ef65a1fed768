"""Text and number features for the models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    StandardScaler,
    StopWordsRemover,
    Tokenizer,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame, functions as F

from agora.functions import text, timeparts
from agora.ml.wordvectors import WordVectors

SEED = 42
NUMBERS = ("vote_count", "average_rating", "view_count", "days_since_created", "comment_count")
TRAIN_TENTHS = 8


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Redistribute a table that lies in few parts before many passes over it.

    ``None`` keeps the partitions of the input, which is right for large tables.
    """
    return df if partitions is None else df.repartition(partitions)


def word_stages(source: str = "combined_text", words: str = "filtered_words") -> list:
    return [
        Tokenizer(inputCol=source, outputCol="words"),
        StopWordsRemover(inputCol="words", outputCol=words),
    ]


def tokens(df: DataFrame) -> DataFrame:
    """Lower-case words of title and description without stop words."""
    rows = df.withColumn("combined_text", text.combined_text("title", "description"))
    return Pipeline(stages=word_stages()).fit(rows).transform(rows)


def text_stages(
    vocabulary: int = 5000,
    min_documents: float = 2.0,
    vector_size: int = 100,
    min_count: int = 1,
    partitions: int = 1,
) -> list:
    """TF-IDF over the commonest words and averaged word vectors.

    Word vectors are trained on ``partitions`` parts of the text side by side, or more if these would be large.
    """
    return [
        *word_stages(),
        CountVectorizer(
            inputCol="filtered_words", outputCol="raw_features", vocabSize=vocabulary, minDF=min_documents
        ),
        IDF(inputCol="raw_features", outputCol="tfidf_features"),
        WordVectors(
            inputCol="filtered_words",
            outputCol="word2vec_features",
            vectorSize=vector_size,
            minCount=min_count,
            numPartitions=partitions,
            seed=SEED,
        ),
    ]


def number_stages() -> list:
    """Five idea metrics, scaled to unit standard deviation."""
    return [
        VectorAssembler(inputCols=list(NUMBERS), outputCol="numerical_features", handleInvalid="keep"),
        StandardScaler(inputCol="numerical_features", outputCol="scaled_numerical_features"),
    ]


def in_training_set(key: str = "idea_id") -> Column:
    """Eighty percent of the ids by hash: the same split however the rows are partitioned."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(10)) < TRAIN_TENTHS


def popularity_features(ideas: DataFrame) -> DataFrame:
    """Title and description length, question mark and hour of day."""
    return ideas.withColumns(
        {
            "title_length": text.token_count("title"),
            "description_length": text.token_count("description"),
            "has_question_mark": text.has_question_mark("title"),
            "hour_created": timeparts.hour_fraction("created_at"),
        }
    )


def success_features(ideas: DataFrame) -> DataFrame:
    """Title and description length in blank-separated pieces; age and category come along."""
    return ideas.withColumns(
        {"title_length": text.token_count("title", " "), "description_length": text.token_count("description", " ")}
    )
