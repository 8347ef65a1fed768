"""Idea clusters and topics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from agora.functions import text
from agora.ml import features


@dataclass
class Clusters:
    """Assignments (one row per idea), sizes, the strongest terms, and the model."""

    assignments: DataFrame
    sizes: DataFrame
    terms: DataFrame | None
    silhouette: float
    model: PipelineModel


def cluster_ideas(
    ideas: DataFrame, k: int = 10, path: str | None = None, partitions: int | None = None, min_count: int = 1
) -> Clusters:
    """K-means over TF-IDF, word vectors and scaled idea metrics.

    ``min_count`` is the least frequency of a word with a vector. The vectors lie in a table
    (400 bytes a word), of which a task sees its part.
    """
    kept = ["idea_id", "title", "description", "category", *features.NUMBERS]
    ideas = features.spread(ideas.select(*kept), partitions)
    rows = ideas.withColumn("combined_text", text.combined_text("title", "description")).fillna(
        0, list(features.NUMBERS)
    )
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    prepare = Pipeline(
        # Word vectors come last of what is trained, so that no other stage reads them.
        stages=[
            *features.number_stages(),
            *features.text_stages(
                min_count=min_count,
                partitions=ideas.sparkSession.sparkContext.defaultParallelism,
            ),
            VectorAssembler(
                inputCols=["tfidf_features", "word2vec_features", "scaled_numerical_features"],
                outputCol="features",
            ),
        ]
    ).fit(rows)
    prepared = prepare.transform(rows).select(
        "idea_id", "title", "category", "vote_count", "average_rating", "features", "place"
    )
    if partitions is not None:
        # Averaging word vectors has dealt the rows anew; k-means draws its first centres by their places.
        prepared = prepared.repartitionById(partitions, F.shiftright("place", 33).cast("int")).sortWithinPartitions("place")
    # K-means reads its input once per iteration.
    prepared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kmeans = KMeans(k=k, seed=features.SEED, featuresCol="features", predictionCol="cluster_id").fit(prepared)
        clustered = kmeans.transform(prepared)
        silhouette = ClusteringEvaluator(
            predictionCol="cluster_id", featuresCol="features", metricName="silhouette"
        ).evaluate(clustered)
        # Kept as a table of small rows, so that the vectors can go.
        assigned = clustered.select("idea_id", "title", "category", "cluster_id", "vote_count", "average_rating")
        assigned.persist(StorageLevel.MEMORY_AND_DISK).count()
    finally:
        prepared.unpersist()
    model = PipelineModel(stages=[*prepare.stages, kmeans])
    if path is not None:
        model.write().overwrite().save(path)
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("idea_count"))
    return Clusters(assigned, sizes, None, silhouette, model)


def cluster_topics(
    ideas: DataFrame,
    k: int = 8,
    vocabulary: int = 1000,
    top_terms: int = 10,
    partitions: int | None = None,
) -> Clusters:
    """K-means over word counts, with the strongest terms of every centre.

    The ideas of a cluster stay rows of ``assignments``; a list per cluster would pull
    the titles of a large cluster into one record.
    """
    rows = features.spread(ideas.select("idea_id", "title", "description"), partitions).select(
        "idea_id", "title", text.normalised_text("title", "description").alias("combined_text")
    )
    prepare = Pipeline(
        stages=[
            *features.word_stages(),
            CountVectorizer(
                inputCol="filtered_words", outputCol="features", minDF=2.0, vocabSize=vocabulary
            ),
        ]
    ).fit(rows)
    prepared = prepare.transform(rows).select("idea_id", "title", "features")
    prepared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kmeans = KMeans(k=k, seed=features.SEED, featuresCol="features", predictionCol="cluster").fit(prepared)
        clustered = kmeans.transform(prepared)
        silhouette = ClusteringEvaluator(predictionCol="cluster").evaluate(clustered)
    finally:
        prepared.unpersist()
    assigned = clustered.select("idea_id", "title", "cluster")
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("idea_count"))
    model = PipelineModel(stages=[*prepare.stages, kmeans])
    return Clusters(assigned, sizes, centre_terms(ideas.sparkSession, model, top_terms), silhouette, model)


def centre_terms(spark: SparkSession, model: PipelineModel, n: int = 10) -> DataFrame:
    """The ``n`` heaviest terms of each cluster centre (model data: clusters times vocabulary)."""
    words = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    rows = []
    for cluster, centre in enumerate(model.stages[-1].clusterCenters()):
        ranked = sorted(range(len(words)), key=lambda i: (-centre[i], words[i]))[:n]
        rows += [(cluster, rank + 1, words[i], float(centre[i])) for rank, i in enumerate(ranked)]
    return spark.createDataFrame(rows, "cluster_id int, rank int, term string, weight double")


def cluster_profile(assignments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Ideas and mean engagement per cluster."""
    return (
        assignments.select("idea_id", "cluster_id")
        .join(metrics.select("idea_id", "engagement_score"), "idea_id")
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("idea_count"), F.avg("engagement_score").alias("avg_engagement"))
    )


@dataclass
class Topics:
    """Topic mixture per idea, the terms of every topic, and the model."""

    mixtures: DataFrame
    terms: DataFrame
    model: PipelineModel


def model_topics(
    ideas: DataFrame,
    k: int = 10,
    iterations: int = 20,
    vocabulary: int = 5000,
    path: str | None = None,
    partitions: int | None = None,
) -> Topics:
    """LDA topics over title and description."""
    rows = features.spread(ideas.select("idea_id", "title", "description"), partitions).select("idea_id", "title", text.combined_text("title", "description").alias("combined_text"))
    prepare = Pipeline(
        stages=[
            *features.word_stages(),
            CountVectorizer(inputCol="filtered_words", outputCol="features", vocabSize=vocabulary, minDF=2.0),
        ]
    ).fit(rows)
    prepared = prepare.transform(rows).select("idea_id", "title", "features")
    prepared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lda = LDA(k=k, seed=features.SEED, maxIter=iterations).fit(prepared)
    finally:
        prepared.unpersist()
    model = PipelineModel(stages=[*prepare.stages, lda])
    if path is not None:
        model.write().overwrite().save(path)
    words = prepare.stages[-1].vocabulary
    described = (
        lda.describeTopics(10)
        .select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
        .select(
            "topic",
            (F.col("rank") + 1).alias("rank"),
            F.col("t.termIndices").alias("index"),
            F.col("t.termWeights").alias("weight"),
        )
    )
    names = ideas.sparkSession.createDataFrame(list(enumerate(words)), "index int, term string")
    terms = described.join(names, "index").select("topic", "rank", "term", "weight")
    mixtures = lda.transform(prepared).select(
        "idea_id", "title", vector_to_array("topicDistribution").alias("topic_distribution")
    )
    return Topics(mixtures, terms, model)


def topic_trend(mixtures: DataFrame, ideas: DataFrame, period: str = "week") -> DataFrame:
    """Share of every topic per period."""
    dated = mixtures.join(ideas.select("idea_id", F.date_trunc(period, "created_at").alias("period")), "idea_id")
    return (
        dated.select("period", F.posexplode("topic_distribution").alias("topic", "share"))
        .groupBy("topic", "period")
        .agg(F.avg("share").alias("topic_share"))
    )


@dataclass
class Hierarchy:
    """Cluster of every idea per level, sizes with the parent of each cluster, and silhouettes."""

    assignments: DataFrame
    sizes: DataFrame
    silhouettes: dict[int, float]


def cluster_hierarchy(ideas: DataFrame, levels: int = 3, vocabulary: int = 1000, partitions: int | None = None) -> Hierarchy:
    """Bisecting k-means over TF-IDF: level ``l`` has up to 2**l clusters, each one half of a cluster above.

    A level repeats the splits of the one before and goes on from there. A cluster's parent is the
    cluster above that most of its ideas lie in; ``shared`` is their number.
    """
    if levels < 1:
        raise ValueError("a hierarchy has one level at least")
    rows = features.spread(ideas.select("idea_id", "title", "description"), partitions).select(
        "idea_id", text.normalised_text("title", "description").alias("combined_text")
    )
    prepare = Pipeline(
        stages=[
            *features.word_stages(),
            CountVectorizer(inputCol="filtered_words", outputCol="counts", minDF=2.0, vocabSize=vocabulary),
            IDF(inputCol="counts", outputCol="weighted"),
            Normalizer(inputCol="weighted", outputCol="features"),
        ]
    ).fit(rows)
    prepared = prepare.transform(rows).select("idea_id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    silhouettes, found = {}, prepared
    try:
        for level in range(1, levels + 1):
            name = f"level_{level}"
            model = BisectingKMeans(k=2**level, seed=features.SEED, featuresCol="features", predictionCol=name).fit(prepared)
            found = model.transform(found)
            if len(model.clusterCenters()) > 1:
                measure = ClusteringEvaluator(predictionCol=name, featuresCol="features")
                silhouettes[level] = measure.evaluate(model.transform(prepared))
        # Kept as a table of small rows, so that the vectors can go.
        assignments = found.drop("features").persist(StorageLevel.MEMORY_AND_DISK)
        assignments.count()
    finally:
        prepared.unpersist()
    parts = []
    for level in range(1, levels + 1):
        above = F.col(f"level_{level - 1}") if level > 1 else F.lit(0)
        pairs = assignments.groupBy(F.col(f"level_{level}").alias("cluster_id"), above.alias("parent")).agg(F.count(F.lit(1)).alias("shared"))
        parts.append(
            pairs.groupBy("cluster_id")
            .agg(
                F.sum("shared").alias("idea_count"),
                F.max_by("parent", F.struct("shared", -F.col("parent"))).alias("parent"),
                F.max("shared").alias("shared"),
            )
            .select(F.lit(level).alias("level"), "cluster_id", "parent", "idea_count", "shared")
        )
    return Hierarchy(assignments, reduce(DataFrame.unionByName, parts), silhouettes)
