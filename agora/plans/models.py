"""The complete model run: clusters, topics, training and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from agora.ml import success, topics
from agora.sources.tables import TableStore, load


def join_metrics(ideas: DataFrame, metrics: DataFrame) -> DataFrame:
    """Ideas with the metrics columns they lack themselves."""
    extra = [c for c in metrics.columns if c not in ideas.columns]
    return ideas.join(metrics.select("idea_id", *extra), "idea_id", "left")


def run_models(
    spark: SparkSession, store: TableStore, model_dir: str, recent_days: int = 7, clusters: int = 10, k_topics: int = 10
) -> dict[str, float]:
    """Write idea clusters, topics and predictions for recent ideas; return quality figures."""
    ideas, metrics = load(store, spark, "ideas", "idea_metrics_batch")
    rows = join_metrics(ideas, metrics)
    clustered = topics.cluster_ideas(rows, clusters, f"{model_dir}/idea_clusters")
    store.write(clustered.assignments, "idea_clusters", "overwrite")
    found = topics.model_topics(rows, k_topics, path=f"{model_dir}/idea_topics")
    store.write(found.mixtures, "idea_topics", "overwrite")
    trained = success.train_success(rows, path=f"{model_dir}/idea_success")
    recent = rows.where(F.col("days_since_created") <= recent_days)
    predictions = success.predict_success(recent, f"{model_dir}/idea_success")
    store.write(predictions, "idea_success_predictions", "overwrite")
    return {"silhouette": clustered.silhouette, "accuracy": trained.accuracy, "auc": trained.auc}
