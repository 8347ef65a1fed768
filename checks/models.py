"""Model queries. Their results depend on training, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.ml import selection, success, topics
from agora.operators import ideas as idea_jobs
from agora.sources.adapter import AS_OF
from checks.registry import query


def metrics_of(t):
    return idea_jobs.idea_metrics(t.rated_ideas, t.votes, t.comments, AS_OF)


def cores(t):
    """The test tables lie in one file each; the models are trained on all cores."""
    return t.spark.sparkContext.defaultParallelism


@query("idea_clusters", "idea_id:i category:s cluster_id:i vote_count:i average_rating:f")
def _(t):
    return topics.cluster_ideas(metrics_of(t), partitions=cores(t)).assignments


@query("topic_clusters", "cluster_id:i rank:i term:s weight:f")
def _(t):
    return topics.cluster_topics(t.ideas, partitions=cores(t)).terms


@query("idea_topics", "idea_id:i topic_count:i total_share:f")
def _(t):
    mixtures = topics.model_topics(t.ideas, partitions=cores(t)).mixtures
    return mixtures.select(
        "idea_id",
        F.size("topic_distribution").alias("topic_count"),
        F.aggregate("topic_distribution", F.lit(0.0), lambda a, x: a + x).alias("total_share"),
    )


@query("popularity_predictions", "idea_id:i is_successful:f prediction:f")
def _(t):
    return success.train_popularity(t.ideas, t.votes, partitions=cores(t)).predictions


@query("success_predictions", "idea_id:i category:s success_probability:f prediction:f success_likelihood:s")
def _(t):
    metrics = metrics_of(t)
    model = success.train_success(metrics, partitions=cores(t)).model
    return success.predict_success(metrics.where("days_since_created <= 7"), model)


@query("model_selection", "settings:s metric:f metric_stddev:f folds:i is_best:b")
def _(t):
    return selection.select_success_model(metrics_of(t), "logistic", {"regParam": (0.01, 0.1)}, partitions=cores(t)).record


@query("success_reliability", "bin:i predictions:i mean_predicted:f observed:f gap:f")
def _(t):
    metrics = metrics_of(t)
    chosen = selection.select_success_model(metrics, "logistic", {"regParam": (0.01,)}, partitions=cores(t))
    scores = selection.held_out_scores(metrics, chosen.model, partitions=cores(t))
    return selection.reliability(scores, "probability", "is_successful")


@query(
    "confidence_reliability",
    "bin:i predictions:i mean_predicted:f observed:f gap:f",
    """SELECT bin, count(*) AS predictions, avg(p) AS mean_predicted, avg(hit) AS observed, avg(hit) - avg(p) AS gap FROM (
           SELECT least(confidence_score, 1.0) AS p, least(floor(least(confidence_score, 1.0) * 10), 9) AS bin,
                  CASE WHEN feedback_score >= 3 THEN 1.0::DOUBLE ELSE 0 END AS hit
           FROM recommendations WHERE feedback_score IS NOT NULL
       ) GROUP BY bin""",
)
def _(t):
    liked = F.when(F.col("feedback_score").isNotNull(), (F.col("feedback_score") >= 3).cast("int"))
    return selection.reliability(t.recommendations.withColumn("liked", liked), "confidence_score", "liked")


@query("cluster_hierarchy", "level:i cluster_id:i parent:i idea_count:i shared:i")
def _(t):
    return topics.cluster_hierarchy(t.ideas, levels=3, partitions=cores(t)).sizes
