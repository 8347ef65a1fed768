"""Decision suggestions from configurable criteria."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Criterion:
    """One row of the criteria configuration; the defaults are the stored ones."""

    criteria_id: int
    name: str
    category: str | None = None
    min_vote_count: int = 10
    min_engagement_score: float = 0.0
    min_average_rating: float = 3.0
    max_controversy_score: float = 0.5
    min_days_since_created: int = 7
    max_days_in_review: int = 30
    min_success_probability: float = 0.6
    required_cluster_size: int = 5
    suggested_decision_type: str = "implementation"
    auto_approve: bool = False
    is_active: bool = True


# What each met threshold adds to the confidence, the share of checks that
# must be met, the answer without a match, and the bars for automation.
WEIGHTS = {"votes": 0.2, "engagement": 0.2, "rating": 0.2, "controversy": 0.1, "success": 0.3}
REQUIRED_SHARE = 0.6
DEFAULT_TYPE, DEFAULT_CONFIDENCE = "deferral", 0.3
AUTO_APPROVE_ABOVE = 0.8
REVIEW_BELOW = 0.8


def load_criteria(table: DataFrame) -> list[Criterion]:
    """Read a criteria configuration into objects, for editing. Scoring takes the table itself."""
    names = [f.name for f in fields(Criterion)]
    rows = table.select(*[c for c in names if c in table.columns]).collect()
    return [Criterion(**{k: v for k, v in row.asDict().items() if v is not None}) for row in rows]


def active_criteria(criteria: DataFrame, category: str | None = None) -> DataFrame:
    found = criteria.where("is_active")
    return found if category is None else found.where(F.col("category") == category)


def _literal(c: Criterion) -> Column:
    return F.struct(
        F.lit(c.criteria_id).alias("id"),
        F.lit(c.name).alias("name"),
        F.lit(c.min_vote_count).cast("long").alias("votes"),
        F.lit(float(c.min_engagement_score)).alias("engagement"),
        F.lit(float(c.min_average_rating)).alias("rating"),
        F.lit(float(c.max_controversy_score)).alias("controversy"),
        F.lit(c.min_days_since_created).alias("age"),
        F.lit(float(c.min_success_probability)).alias("success"),
        F.lit(c.suggested_decision_type).alias("type"),
        F.lit(c.auto_approve).alias("auto"),
    )


def _rules_of(table: DataFrame) -> Column:
    """The active criteria as one array value, a scalar subquery of the plan, by id.

    Null or missing fields have the stored defaults.
    """
    defaults = {f.name: f.default for f in fields(Criterion)}

    def value(name: str, kind: str) -> Column:
        default = F.lit(None if name in ("criteria_id", "name") else defaults[name]).cast(kind)
        return F.coalesce(F.col(name).cast(kind), default) if name in table.columns else default

    one = F.struct(
        value("criteria_id", "int").alias("id"),
        value("name", "string").alias("name"),
        value("min_vote_count", "long").alias("votes"),
        value("min_engagement_score", "double").alias("engagement"),
        value("min_average_rating", "double").alias("rating"),
        value("max_controversy_score", "double").alias("controversy"),
        value("min_days_since_created", "int").alias("age"),
        value("min_success_probability", "double").alias("success"),
        value("suggested_decision_type", "string").alias("type"),
        value("auto_approve", "boolean").alias("auto"),
    )
    return table.where(value("is_active", "boolean")).agg(F.sort_array(F.collect_list(one))).scalar()


def _checks(rule: Column, metrics: set[str]) -> dict[str, Column]:
    def metric(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in metrics else F.lit(default)

    checks = {
        "votes": metric("vote_count", 0) >= rule["votes"],
        "engagement": metric("engagement_score", 0) >= rule["engagement"],
        "rating": metric("average_rating", 0) >= rule["rating"],
        "controversy": metric("controversy_score", 1) <= rule["controversy"],
    }
    if "success_probability" in metrics:
        checks["success"] = F.col("success_probability") >= rule["success"]
    return checks


def _evaluate(rule: Column, metrics: set[str]) -> Column:
    """Confidence and match of one criterion for the row at hand.

    A check on a missing success probability does not count at all.
    """
    checks = _checks(rule, metrics)
    met = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    hits = reduce(lambda a, b: a + b, [F.when(ok, 1).otherwise(0) for ok in met.values()])
    total = reduce(
        lambda a, b: a + b, [F.when(v.isNull(), 0).otherwise(1) for v in checks.values()]
    )
    # Tenths are whole numbers, so equal confidences compare equal.
    tenths = reduce(
        lambda a, b: a + b, [F.when(ok, round(WEIGHTS[k] * 10)).otherwise(0) for k, ok in met.items()]
    )
    return F.struct(
        (hits >= total * REQUIRED_SHARE).alias("matched"),
        tenths.alias("tenths"),
        (-rule["id"]).alias("first"),
        rule["name"].alias("name"),
        rule["type"].alias("type"),
        rule["auto"].alias("auto"),
    )


def suggest_decisions(metrics: DataFrame, criteria: Sequence[Criterion] | DataFrame) -> DataFrame:
    """The best matching criterion of every idea, or a deferral.

    ``metrics`` needs ``idea_id`` and may have vote_count, engagement_score,
    average_rating, controversy_score and success_probability; a missing metric counts
    as 0, controversy as 1. A table of criteria becomes one array value that every task
    gets, so each idea is scored where it lies: no join, no row per (idea, criterion)
    pair, and a plan of the same size for any number of criteria. Given objects are
    literals. The earliest criterion wins a tie.
    """
    available = set(metrics.columns)
    if isinstance(criteria, DataFrame):
        known = _rules_of(criteria)
    else:
        active = sorted((c for c in criteria if c.is_active), key=lambda c: c.criteria_id)
        # A criterion that is filtered out gives the empty array its type.
        known = F.filter(F.array(*[_literal(c) for c in active or [Criterion(0, "")]]), lambda r: F.lit(bool(active)))
    scored = metrics.withColumn("_rules", known)
    found = F.filter(F.transform("_rules", lambda r: _evaluate(r, available)), lambda e: e["matched"])
    scored = scored.withColumn("_found", found).withColumn(
        "_best",
        F.array_max(
            F.transform("_found", lambda e: F.struct(e["tenths"], e["first"], e["type"], e["auto"]))
        ),
    )
    confidence = F.coalesce(F.col("_best.tenths") / F.lit(10.0), F.lit(DEFAULT_CONFIDENCE))
    return scored.select(
        "idea_id",
        F.coalesce("_best.type", F.lit(DEFAULT_TYPE)).alias("suggested_decision_type"),
        confidence.alias("confidence_score"),
        F.transform("_found", lambda e: e["name"]).alias("matching_criteria"),
        (F.coalesce(F.col("_best.auto"), F.lit(False)) & (confidence > AUTO_APPROVE_ABOVE)).alias(
            "auto_approve_eligible"
        ),
        (confidence < REVIEW_BELOW).alias("needs_review"),
    )


def rationale(suggestion: Column | str) -> Column:
    kind = F.col(suggestion) if isinstance(suggestion, str) else suggestion
    return F.when(
        kind == DEFAULT_TYPE, "Idea does not meet minimum criteria for implementation"
    ).otherwise(F.concat(F.lit("Idea meets criteria for "), kind))


def meets_all(metrics: DataFrame, criterion: Criterion) -> DataFrame:
    """The strict variant: every threshold, including the age, must be met."""
    rule = _literal(criterion)
    checks = _checks(rule, set(metrics.columns) - {"success_probability"})
    checks["age"] = F.col("days_since_created") >= rule["age"]
    ok = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks.values()])
    return metrics.select(
        "idea_id",
        *[c.alias(f"meets_{name}") for name, c in checks.items()],
        ok.alias("meets_criteria"),
        F.when(ok, F.lit(criterion.suggested_decision_type)).otherwise(F.lit(DEFAULT_TYPE)).alias(
            "suggested_decision"
        ),
    )


def batch_summary(suggestions: DataFrame) -> DataFrame:
    """How many ideas a batch run approves, queues for people or defers."""
    return suggestions.groupBy(batch_outcome().alias("outcome")).agg(
        F.count(F.lit(1)).alias("idea_count"), F.avg("confidence_score").alias("avg_confidence")
    )


def batch_outcome() -> Column:
    return (
        F.when(F.col("auto_approve_eligible"), "auto_approved")
        .when(F.col("suggested_decision_type") == DEFAULT_TYPE, "deferred")
        .otherwise("manual_review")
    )


def criteria_quality(suggestions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Confusion counts and error rates of suggestions against what became of the ideas.

    ``outcomes`` has one row per idea with the boolean ``succeeded``.
    """
    predicted = F.col("suggested_decision_type") == "implementation"
    counts = (
        suggestions.select("idea_id", predicted.alias("predicted"))
        .join(outcomes.select("idea_id", "succeeded"), "idea_id")
        .agg(
            F.count_if(F.col("predicted") & F.col("succeeded")).alias("true_positives"),
            F.count_if(F.col("predicted") & ~F.col("succeeded")).alias("false_positives"),
            F.count_if(~F.col("predicted") & F.col("succeeded")).alias("false_negatives"),
            F.count_if(~F.col("predicted") & ~F.col("succeeded")).alias("true_negatives"),
        )
    )
    fp, tn = F.col("false_positives"), F.col("true_negatives")
    fn, tp = F.col("false_negatives"), F.col("true_positives")
    return counts.withColumn(
        "false_positive_rate", F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0)
    ).withColumn("false_negative_rate", F.when(fn + tp > 0, fn / (fn + tp)).otherwise(0.0))


# Bars for warnings about decisions that contradict the idea's score.
LOW_SCORE, HIGH_SCORE = 0.5, 0.8


def decision_warnings(decisions: DataFrame, score: str = "score") -> DataFrame:
    """Decisions that contradict their idea's score or lack a type or status."""
    verdict = (
        F.when(F.col("decision_type").isNull() | (F.col("decision_type") == ""), "type_required")
        .when(F.col("status").isNull() | (F.col("status") == ""), "status_required")
        .when((F.col("decision_type") == "implementation") & (F.col(score) < LOW_SCORE), "score_too_low")
        .when((F.col("decision_type") == "rejection") & (F.col(score) >= HIGH_SCORE), "high_score_rejected")
    )
    return (
        decisions.withColumn("finding", verdict)
        .where(F.col("finding").isNotNull())
        .withColumn("severity", F.when(F.col("finding") == "high_score_rejected", "warning").otherwise("error"))
    )


# Metric alert thresholds (percent, percent, milliseconds, percent).
METRIC_THRESHOLDS = {"cpu_usage": 80.0, "memory_usage": 85.0, "response_time": 2000.0, "error_rate": 5.0}
LOW_SENTIMENT = -0.7


def metric_alerts(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Metric values strictly above the threshold of their name. Batch or stream."""
    limits = METRIC_THRESHOLDS if thresholds is None else thresholds
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return metrics.withColumn("threshold", F.try_element_at(table, F.col("metric_name"))).where(
        F.col("metric_value") > F.col("threshold")
    )


def metric_alerts_from_table(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The same with thresholds from a table, which Spark broadcasts if it is small."""
    return metrics.join(thresholds, "metric_name").where(F.col("metric_value") > F.col("threshold"))


def low_sentiment(thoughts: DataFrame, below: float = LOW_SENTIMENT) -> DataFrame:
    return thoughts.where(F.col("sentiment_score") < below)
