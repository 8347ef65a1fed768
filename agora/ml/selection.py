"""Model selection over hashed folds, a logistic success model, and how well scores are calibrated."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from agora.ml import features
from agora.ml.success import SUCCESS_COLUMNS, success_examples, without_summary

FOLDS = 3
BINS = 10
#: Settings that are compared by default, per kind of model.
GRIDS: dict[str, dict[str, Sequence]] = {
    "forest": {"numTrees": (20, 50), "maxDepth": (3, 5)},
    "logistic": {"regParam": (0.0, 0.01, 0.1), "elasticNetParam": (0.0, 0.5)},
}


@dataclass
class Selected:
    """The best settings refitted on all training rows, and what every setting scored."""

    model: PipelineModel
    settings: dict[str, float]
    metric: float
    record: DataFrame


def fold_of(key: Column | str, folds: int = FOLDS) -> Column:
    """The fold of a row by the hash of its id: the same however rows are partitioned."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(key, F.lit(features.SEED), F.lit("fold")), F.lit(folds)).cast("int")


def success_stages(estimator: Estimator) -> list:
    """Category and numbers, scaled to unit deviation, before an estimator of ``is_successful``."""
    return [
        StringIndexer(inputCol="category", outputCol="category_index", handleInvalid="keep"),
        OneHotEncoder(inputCols=["category_index"], outputCols=["category_encoded"], handleInvalid="keep"),
        VectorAssembler(inputCols=list(SUCCESS_COLUMNS), outputCol="unscaled", handleInvalid="keep"),
        StandardScaler(inputCol="unscaled", outputCol="features"),
        estimator,
    ]


def estimator_of(kind: str) -> Estimator:
    if kind == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol="is_successful", seed=features.SEED)
    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="is_successful")
    raise ValueError(f"unknown kind of model: {kind}")


def select_model(
    rows: DataFrame,
    stages: list,
    grid: Mapping[str, Sequence],
    evaluator: Evaluator,
    folds: int = FOLDS,
    key: str = "idea_id",
    parallelism: int = 2,
) -> Selected:
    """Fit every combination of settings on all folds but one, and refit the best on all rows.

    The settings are parameters of the last stage. Rows are dealt to as many parts as the session
    shuffles to, by id, and ordered in them: samples that trees draw per part are the same again,
    so equal rows give equal folds, figures and model. The first of equally good settings wins.
    """
    last = stages[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(last.getParam(name), list(values))
    combinations = [dict(zip(grid, values)) for values in product(*grid.values())]
    # Every fit reads the rows several times.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("fold", fold_of(key, folds)).repartition(parts, key).sortWithinPartitions(key)
    kept = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = CrossValidator(
            estimator=Pipeline(stages=stages),
            estimatorParamMaps=builder.build(),
            evaluator=evaluator,
            numFolds=folds,
            foldCol="fold",
            parallelism=parallelism,
        ).fit(kept)
    finally:
        kept.unpersist()
    sign = 1 if evaluator.isLargerBetter() else -1
    best = max(range(len(combinations)), key=lambda k: (sign * found.avgMetrics[k], -k))
    record = [
        (json.dumps(settings, sort_keys=True), float(found.avgMetrics[k]), float(found.stdMetrics[k]), folds, k == best)
        for k, settings in enumerate(combinations)
    ]
    table = rows.sparkSession.createDataFrame(
        record, "settings string, metric double, metric_stddev double, folds int, is_best boolean"
    )
    return Selected(without_summary(found.bestModel), combinations[best], float(found.avgMetrics[best]), table)


def select_success_model(
    metrics: DataFrame, kind: str = "forest", grid: Mapping[str, Sequence] | None = None, folds: int = FOLDS, partitions: int | None = None
) -> Selected:
    """The best success model of a kind, by area under the curve over the folds of the training ideas."""
    rows = success_rows(metrics, partitions).where(features.in_training_set())
    evaluator = BinaryClassificationEvaluator(labelCol="is_successful", metricName="areaUnderROC")
    return select_model(rows, success_stages(estimator_of(kind)), grid or GRIDS[kind], evaluator, folds)


def success_rows(metrics: DataFrame, partitions: int | None = None) -> DataFrame:
    rows = success_examples(metrics).select(
        "idea_id", "title", "category", "days_since_created", "title_length", "description_length", "is_successful"
    )
    return features.spread(rows, partitions)


def held_out_scores(metrics: DataFrame, model: PipelineModel, partitions: int | None = None) -> DataFrame:
    """(idea_id, is_successful, probability) of the ideas that training didn't see."""
    rows = success_rows(metrics, partitions).where(~features.in_training_set())
    score = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(rows).select("idea_id", "is_successful", score.alias("probability"))


def reliability(scored: DataFrame, probability: str, label: str, bins: int = BINS) -> DataFrame:
    """Per tenth of the predicted probability: number, mean prediction, share that came true, gap.

    Rows without a prediction or a label are left out; predictions outside 0 to 1 belong to
    the first and last bin. Empty bins have no row.
    """
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(probability).cast("double")))
    rows = scored.where(F.col(probability).isNotNull() & F.col(label).isNotNull())
    place = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    found = rows.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("predictions"), F.avg(p).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed")
    )
    return found.withColumn("gap", F.col("observed") - F.col("mean_predicted"))


def calibration_error(bins: DataFrame) -> Column:
    """The mean absolute gap of a reliability table, weighted by the predictions, as a scalar."""
    weighted = F.sum(F.col("predictions") * F.abs("gap")) / F.sum("predictions")
    return bins.agg(weighted.alias("calibration_error")).scalar()
