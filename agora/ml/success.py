"""Success prediction with random forests."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from agora.functions import scores
from agora.ml import features
from agora.operators import votes as vote_jobs

POPULARITY_COLUMNS = ("title_length", "description_length", "has_question_mark", "hour_created")
FOREST_PARAMETERS = ("numTrees", "maxDepth", "maxBins", "minInstancesPerNode", "subsamplingRate", "impurity", "seed")
SUCCESS_COLUMNS = ("days_since_created", "title_length", "description_length", "category_encoded")


@dataclass
class Trained:
    """A fitted model with what was measured on the held-out ideas."""

    name: str
    model: PipelineModel
    accuracy: float
    auc: float | None
    importances: dict[str, float]
    seconds: float
    predictions: DataFrame = field(repr=False)
    precision: float = 0.0
    recall: float = 0.0
    f1: float = 0.0
    parameters: dict[str, str] = field(default_factory=dict)

    def metrics(self, spark: SparkSession) -> DataFrame:
        """The model record, one row."""
        row = [(self.name, "1.0", self.accuracy, self.precision, self.recall, self.f1, self.auc, self.seconds,
                self.importances, self.parameters)]
        return spark.createDataFrame(
            row,
            "model_name string, version string, accuracy double, precision double, recall double, f1_score double,"
            " auc_roc double, training_time_seconds double, feature_importance map<string,double>,"
            " hyperparameters map<string,string>",
        )


def without_summary(model: PipelineModel) -> PipelineModel:
    """The model, its last stage copied without the summary of its training.

    The summary holds the session and with it whatever the session holds; a model that
    carries it can't travel to tasks once something was observed in the session.
    """
    last = model.stages[-1].copy()
    if getattr(last, "hasSummary", False):  # some kinds of models copy it
        last._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return PipelineModel([*model.stages[:-1], last])


def _fit(
    name: str, rows: DataFrame, stages: list, label: str, inputs: tuple[str, ...], partitions: int | None
) -> Trained:
    started = time.monotonic()
    # The forest and the evaluators read the rows several times.
    rows = features.spread(rows, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = rows.where(features.in_training_set()), rows.where(~features.in_training_set())
    model = without_summary(Pipeline(stages=stages).fit(train))
    predictions = model.transform(test)
    # Measured on one small table of (label, prediction, probability).
    measured = predictions.select(label, "prediction", "rawPrediction").persist(StorageLevel.MEMORY_AND_DISK)
    kinds = ("accuracy", "weightedPrecision", "weightedRecall", "f1")
    accuracy, precision, recall, f1 = (
        MulticlassClassificationEvaluator(labelCol=label, metricName=kind).evaluate(measured) for kind in kinds
    )
    # With a single class in the training rows there is no curve to measure.
    auc = None
    if model.stages[-1].numClasses == 2:
        auc = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC").evaluate(measured)
    measured.unpersist()
    rows.unpersist()
    forest = model.stages[-1]
    parameters = {p.name: str(v) for p, v in forest.extractParamMap().items() if p.name in FOREST_PARAMETERS}
    weights = model.stages[-1].featureImportances.toArray()
    # An encoded category fills the tail of the vector; its parts are added up.
    importances = {c: float(weights[i]) for i, c in enumerate(inputs[:-1])}
    importances[inputs[-1]] = float(weights[len(inputs) - 1 :].sum())
    seconds = time.monotonic() - started
    return Trained(name, model, accuracy, auc, importances, seconds, predictions, precision, recall, f1, parameters)


def popularity_examples(ideas: DataFrame, votes: DataFrame) -> DataFrame:
    """Ideas with the plain features and the label: many upvotes at a high ratio."""
    stats = vote_jobs.vote_counts(votes).select("idea_id", "total_votes", "upvotes")
    joined = ideas.join(stats, "idea_id", "left").fillna(0, ["total_votes", "upvotes"])
    return features.popularity_features(joined).withColumn(
        "is_successful", scores.popular_label("upvotes", scores.ratio("upvotes", "total_votes"))
    )


def train_popularity(ideas: DataFrame, votes: DataFrame, partitions: int | None = None) -> Trained:
    """Predict popularity from the form of an idea (default forest)."""
    stages = [
        VectorAssembler(inputCols=list(POPULARITY_COLUMNS), outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="features", labelCol="is_successful", seed=features.SEED),
    ]
    rows = popularity_examples(ideas, votes).select("idea_id", "title", *POPULARITY_COLUMNS, "is_successful")
    return _fit("idea_popularity", rows, stages, "is_successful", POPULARITY_COLUMNS, partitions)


def success_examples(metrics: DataFrame) -> DataFrame:
    """Idea metrics with text lengths and the label: implemented, or engaging twice the mean."""
    mean = metrics.agg(F.avg("engagement_score")).scalar()
    label = scores.success_label("status", "engagement_score", mean).cast("double")
    return features.success_features(metrics).withColumn("is_successful", label)


def train_success(
    metrics: DataFrame, trees: int = 100, path: str | None = None, partitions: int | None = None
) -> Trained:
    """Predict success from age, text lengths and category.

    The whole pipeline is stored, so prediction encodes categories as training did.
    """
    stages = [
        StringIndexer(inputCol="category", outputCol="category_index", handleInvalid="keep"),
        OneHotEncoder(inputCols=["category_index"], outputCols=["category_encoded"], handleInvalid="keep"),
        VectorAssembler(inputCols=list(SUCCESS_COLUMNS), outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(
            featuresCol="features", labelCol="is_successful", numTrees=trees, seed=features.SEED
        ),
    ]
    rows = success_examples(metrics).select(
        "idea_id", "title", "category", "days_since_created", "title_length", "description_length", "is_successful"
    )
    trained = _fit("idea_success", rows, stages, "is_successful", SUCCESS_COLUMNS, partitions)
    if path is not None:
        trained.model.write().overwrite().save(path)
    return trained


def predict_success(ideas: DataFrame, model: PipelineModel | str) -> DataFrame:
    """Success probability and likelihood band of ideas; needs no label columns."""
    fitted = PipelineModel.load(model) if isinstance(model, str) else model
    predicted = fitted.transform(features.success_features(ideas))
    return predicted.select(
        "idea_id",
        "title",
        "category",
        F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)).alias("success_probability"),
        "prediction",
    ).withColumn("success_likelihood", scores.success_likelihood("success_probability"))
