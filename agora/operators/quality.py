"""Row rules, record validation and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from agora import schemas
from agora.functions import scores, text, timeparts

# Patterns of valid ids, addresses and links, and size limits.
USER_ID = r"^[a-zA-Z0-9_-]+$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
IPV4_SHAPE = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
WEB_URL = r"^https?://"
MAX_TEXT, MAX_TAGS, MAX_RECOMMENDED, MAX_BATCH = 10_000, 20, 50, 10_000
MAX_NULL_PERCENT = 10.0
EXTREME_METRIC = 1_000_000

ERROR_FIELDS = "array<struct<field:string,error_type:string,message:string,value:string,severity:string>>"


@dataclass(frozen=True)
class Rule:
    """A named condition on a row; ``ok`` is true, or null, for a row that is fine.

    With ``required`` a null makes the row invalid.
    """

    field: str
    error_type: str
    message: str
    ok: Column
    severity: str = "error"
    required: bool = False

    def broken(self) -> Column:
        return ~F.coalesce(self.ok, F.lit(not self.required))


def _present(field: str, message: str | None = None) -> Rule:
    return Rule(field, "missing", message or f"{field} is required", F.col(field).isNotNull(), required=True)


def _filled(field: str) -> Rule:
    return Rule(field, "empty", f"{field} must not be empty", F.length(field) >= 1, required=True)


def _length(field: str, low: int | None = None, high: int | None = None, required: bool = False) -> Rule:
    size = F.length(field)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (size >= low)
    if high is not None:
        ok = ok & (size <= high)
    return Rule(field, "length", f"{field} must have {low or 0} to {high or 'any number of'} characters", ok, required=required)


def _between(field: str, low: float | None = None, high: float | None = None, required: bool = False) -> Rule:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(field) >= low)
    if high is not None:
        ok = ok & (F.col(field) <= high)
    return Rule(field, "range", f"{field} must be between {low} and {high}", ok, required=required)


def _one_of(field: str, values: Sequence[str], required: bool = False) -> Rule:
    return Rule(field, "choice", f"{field} must be one of the known values", F.col(field).isin(*values), required=required)


def _matches(field: str, pattern: str, message: str) -> Rule:
    """Empty text passes like a missing one; use ``_filled`` to refuse it."""
    return Rule(field, "format", message, (F.col(field) == "") | F.col(field).rlike(pattern))


def user_rules() -> list[Rule]:
    return [
        _length("user_id", 1, 100, required=True),
        Rule("user_id", "format", "only letters, digits, - and _ are allowed", F.col("user_id").rlike(USER_ID)),
        _matches("email", EMAIL, "invalid e-mail format"),
    ]


def interaction_rules() -> list[Rule]:
    return [
        _filled("user_id"),
        _one_of("interaction_type", schemas.INTERACTION_TYPES, required=True),
        _one_of("device_type", schemas.DEVICE_TYPES),
        _matches("ip_address", IPV4_SHAPE, "invalid IP address format"),
        _between("duration_ms", low=0),
    ]


def thought_rules() -> list[Rule]:
    return [
        _filled("user_id"),
        _length("thought_text", 1, MAX_TEXT, required=True),
        Rule("thought_text", "blank", "text must not be blank", ~text.is_blank("thought_text")),
        _between("sentiment_score", -1.0, 1.0),
        Rule("tags", "size", f"at most {MAX_TAGS} tags", F.size("tags") <= MAX_TAGS),
    ]


def content_rules() -> list[Rule]:
    return [
        _length("title", 1, 500, required=True),
        _length("description", high=2000),
        _matches("url", WEB_URL, "URL must start with http:// or https://"),
        _between("view_count", low=0),
        _between("like_count", low=0),
    ]


def metric_rules() -> list[Rule]:
    value = F.col("metric_value")
    return [
        Rule("metric_name", "format", "invalid metric name", F.col("metric_name").rlike(text.METRIC_NAME), required=True),
        Rule("metric_value", "number", "value must be a finite number",
             ~F.isnan(value) & (F.abs(value) != float("inf")), required=True),
        _filled("component"),
    ]


def recommendation_rules() -> list[Rule]:
    ids = F.col("recommended_content")
    return [
        _filled("user_id"),
        Rule("recommended_content", "size", f"1 to {MAX_RECOMMENDED} items", F.size(ids).between(1, MAX_RECOMMENDED), required=True),
        _filled("algorithm"),
        _between("confidence_score", 0.0, 1.0, required=True),
        _between("feedback_score", 0.0, 5.0),
    ]


def session_rules() -> list[Rule]:
    return [_filled("user_id"), _between("page_views", low=0), _between("interactions", low=0)]


def vote_rules() -> list[Rule]:
    is_rating, rating = F.col("vote_type") == "rating", F.col("rating")
    return [
        Rule("idea_id", "range", "idea_id must be positive", F.col("idea_id") > 0, required=True),
        _one_of("vote_type", schemas.VOTE_TYPES, required=True),
        _between("rating", 1.0, 5.0),
        Rule("rating", "missing", "rating votes need a rating", ~is_rating | rating.isNotNull()),
        Rule("rating", "forbidden", "only rating votes carry a rating", is_rating | rating.isNull()),
    ]


def idea_rules() -> list[Rule]:
    return [
        _length("title", 5, 200, required=True),
        _length("description", 20, 5000, required=True),
        _one_of("category", schemas.IDEA_CATEGORIES, required=True),
        Rule("tags", "size", "at most 10 tags", F.size("tags") <= 10),
    ]


def submission_rules() -> list[Rule]:
    """The rules of an idea together with those of its attachments, which only submissions carry."""
    return [*idea_rules(), Rule("attachments", "size", "at most 5 attachments", F.size("attachments") <= 5)]


def comment_rules() -> list[Rule]:
    return [_length("content", 1, 1000, required=True)]


def decision_rules() -> list[Rule]:
    return [
        Rule("idea_id", "range", "idea_id must be positive", F.col("idea_id") > 0, required=True),
        _one_of("decision_type", schemas.DECISION_TYPES, required=True),
        _length("summary", 10, 500, required=True),
        _length("rationale", 20, required=True),
        Rule("timeline_days", "range", "timeline_days must be positive", F.col("timeline_days") > 0),
    ]


def criteria_rules() -> list[Rule]:
    return [
        _length("name", 3, 100, required=True),
        _between("min_vote_count", low=0),
        _between("min_average_rating", 1.0, 5.0),
        _between("max_controversy_score", 0.0, 1.0),
        _between("min_days_since_created", low=0),
        _between("max_days_in_review", low=1),
        _between("min_success_probability", 0.0, 1.0),
        _between("required_cluster_size", low=1),
    ]


def analytics_rules() -> list[Rule]:
    return [
        _present("idea_id"),
        _present("title"),
        _present("created_at"),
        _present("vote_count"),
        _between("average_rating", 0, 5),
        _between("vote_count", low=0),
        Rule("title", "short", "title is very short", F.length("title") >= 3, severity="warning"),
        Rule("vote_count", "high", "unusually high vote count", F.col("vote_count") <= 1000, severity="warning"),
    ]


# Rules per value of ``event_type``.
EVENT_RULES = {
    "user_interaction": interaction_rules,
    "thought_capture": thought_rules,
    "system_metric": metric_rules,
    "recommendation_generated": recommendation_rules,
    "user_session": session_rules,
    "content": content_rules,
    "user": user_rules,
}


def with_errors(df: DataFrame, rules: Sequence[Rule], column: str = "errors") -> DataFrame:
    """Add the list of broken rules to every row; it has at most one entry per rule."""
    entries = [
        F.when(
            r.broken(),
            F.struct(
                F.lit(r.field).alias("field"),
                F.lit(r.error_type).alias("error_type"),
                F.lit(r.message).alias("message"),
                F.col(r.field).cast("string").alias("value")
                if not isinstance(df.schema[r.field].dataType, T.ArrayType)
                else F.to_json(F.col(r.field)).alias("value"),
                F.lit(r.severity).alias("severity"),
            ),
        )
        for r in rules
    ]
    return df.withColumn(column, F.array_compact(F.array(*entries)).cast(ERROR_FIELDS))


def is_valid(errors: str = "errors") -> Column:
    return ~F.exists(errors, lambda e: e["severity"] == "error")


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows in their own schema, and one row per broken rule of the others."""
    checked = with_errors(df, rules)
    good = checked.where(is_valid()).drop("errors")
    bad = checked.where(~is_valid()).withColumn("error", F.explode("errors")).select("*", "error.*").drop("errors", "error")
    return good, bad


def typed_thoughts(thoughts: DataFrame) -> DataFrame:
    """Valid thoughts with stripped text, counts, sentiment category and cleaned tags."""
    good, _ = split_valid(thoughts, thought_rules())
    return (
        good.withColumn("thought_text", text.strip("thought_text"))
        .withColumn("word_count", text.word_count("thought_text"))
        .withColumn("character_count", F.length("thought_text"))
        .withColumn("sentiment_category", text.sentiment_category("sentiment_score", null_as=None))
        .withColumn("tags", text.clean_tags("tags"))
    )


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Broken rows per rule, from one pass over the table."""
    totals = df.agg(
        *[
            F.struct(
                F.lit(r.field).alias("field"),
                F.lit(r.error_type).alias("error_type"),
                F.lit(r.severity).alias("severity"),
                F.count_if(r.broken()).alias("broken_rows"),
            ).alias(f"r{i}")
            for i, r in enumerate(rules)
        ]
    )
    return totals.select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(rules))])))


def quality_report(
    df: DataFrame, rules: Sequence[Rule], dataset: str, required: Sequence[str], consistent: Column | None = None
) -> DataFrame:
    """Totals and scores of a dataset, one row.

    Completeness is the share of filled required fields, accuracy the share of valid
    rows, consistency the share of rows meeting ``consistent`` (1.0 without one).
    """
    broken = F.lit(False)
    for r in rules:
        if r.severity == "error":
            broken = broken | r.broken()
    filled = F.lit(0)
    for name in required:
        filled = filled + F.when(F.col(name).isNotNull(), 1).otherwise(0)
    fits = F.lit(True) if consistent is None else F.coalesce(consistent, F.lit(False))
    return (
        df.agg(
            F.count(F.lit(1)).alias("total_records"),
            F.count_if(~broken).alias("valid_records"),
            F.count_if(broken).alias("invalid_records"),
            F.coalesce(F.sum(filled), F.lit(0)).alias("_filled"),
            F.count_if(fits).alias("_fits"),
        )
        .withColumn("dataset_name", F.lit(dataset))
        .withColumn("completeness_score", scores.ratio("_filled", F.col("total_records") * len(required)))
        .withColumn("accuracy_score", scores.ratio("valid_records", "total_records"))
        .withColumn("consistency_score", scores.ratio("_fits", "total_records"))
        .withColumn(
            "overall_quality_score",
            scores.quality_score("completeness_score", "accuracy_score", "consistency_score"),
        )
        .drop("_filled", "_fits")
    )


def quality_gate(
    report: DataFrame,
    min_completeness: float = 0.9,
    min_accuracy: float = 0.85,
    fail_completeness: float = 0.8,
) -> DataFrame:
    """``succeed``, ``fail_with_warnings`` for gaps or ``fail_data_quality`` for wrong rows."""
    verdict = (
        F.when(F.col("accuracy_score") < min_accuracy, "fail_data_quality")
        .when(F.col("completeness_score") < fail_completeness, "fail_with_warnings")
        .when(F.col("completeness_score") < min_completeness, "succeed_with_warnings")
        .otherwise("succeed")
    )
    return report.withColumn("result", verdict)


def event_batches(events: DataFrame, batch: Column | str = "batch_id", limit: int = MAX_BATCH) -> DataFrame:
    """Size of every batch and whether it is within the limit."""
    key = F.col(batch) if isinstance(batch, str) else batch
    return (
        events.groupBy(key.alias("batch_id"))
        .agg(F.count(F.lit(1)).alias("total_events"))
        .withColumn("is_valid", F.col("total_events").between(1, limit))
    )


def deduplicate(df: DataFrame, keys: Sequence[str], newest: str | None = None) -> DataFrame:
    """One row per key: any of them, or the newest by a column.

    Rows without ``newest`` come before all others; ties go to the greatest text of the row.
    """
    if newest is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(newest).isNotNull(), F.col(newest), F.to_json(F.struct(*rest)))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


# ---------------------------------------------------------------- dataset checks of the ETL

REQUIRED_COLUMNS = {
    "interactions": ("user_id", "timestamp", "interaction_type"),
    "thoughts": ("user_id", "thought_text", "timestamp"),
    "metrics": ("metric_name", "metric_value", "timestamp", "component"),
}


def _dataset_checks(df: DataFrame, kind: str, as_of: datetime | str) -> dict[str, Column]:
    have = set(df.columns)
    checks: dict[str, Column] = {}
    if kind == "interactions":
        for name in REQUIRED_COLUMNS[kind]:
            if name in have:
                checks[f"null_{name}"] = F.col(name).isNull()
        if "timestamp" in have:
            checks["future_timestamps"] = F.col("timestamp") > timeparts.moment(as_of)
    if kind == "thoughts":
        if "thought_text" in have:
            checks["empty_thoughts"] = text.is_blank("thought_text")
            checks["long_thoughts"] = F.length("thought_text") > MAX_TEXT
        if "sentiment_score" in have:
            checks["invalid_sentiment"] = ~F.col("sentiment_score").between(-1, 1)
    if kind == "metrics" and "metric_value" in have:
        checks["negative_values"] = F.col("metric_value") < 0
        checks["extreme_values"] = F.col("metric_value") > EXTREME_METRIC
    return checks


def validate_dataset(df: DataFrame, kind: str, as_of: datetime | str) -> DataFrame:
    """Check an ETL dataset in one pass: one row with counts, issues and the verdict.

    A missing column fails any dataset; more than ten percent nulls in a required column
    fail interactions; everything else is only reported.
    """
    missing = [c for c in REQUIRED_COLUMNS[kind] if c not in df.columns]
    checks = _dataset_checks(df, kind, as_of)
    report = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        *[F.count_if(condition).alias(name) for name, condition in checks.items()],
    )
    passed = F.lit(not missing)
    issues: list[Column] = [F.lit(f"missing column {name}") for name in missing]
    for name in checks:
        note = F.concat(F.lit(f"{name}: "), F.col(name).cast("string"))
        if name.startswith("null_"):
            percent = scores.ratio(F.col(name) * 100, "total_records")
            report = report.withColumn(f"{name}_percent", percent)
            passed = passed & (F.col(f"{name}_percent") <= MAX_NULL_PERCENT)
        issues.append(F.when(F.col(name) > 0, note))
    if kind == "interactions" and dict(df.dtypes).get("user_id", "string") != "string":
        issues.append(F.lit("user_id should be a string"))
    found = F.array_compact(F.array(*issues)) if issues else F.array().cast("array<string>")
    return report.withColumn("passed", passed).withColumn("issues", found)


def valid_events(events: DataFrame, event_type: str) -> tuple[DataFrame, DataFrame]:
    """:func:`split_valid` with the rules registered for an event type."""
    rules: Mapping[str, object] = EVENT_RULES
    if event_type not in rules:
        raise ValueError(f"no rules for event type {event_type!r}")
    return split_valid(events, EVENT_RULES[event_type]())
