"""Schemas of the domain tables and events, and the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies that events and rows are checked against.
IDEA_CATEGORIES = ("innovation", "improvement", "problem_solving", "cost_saving", "revenue_generation", "other")
IDEA_STATUSES = ("draft", "published", "under_review", "implemented", "rejected")
VOTE_TYPES = ("upvote", "downvote", "rating")
VOTE_EVENT_TYPES = ("vote_cast", "vote_removed", "vote_updated")
DECISION_STATUSES = ("pending", "in_review", "approved", "rejected", "implemented", "on_hold")
DECISION_TYPES = ("implementation", "rejection", "modification", "escalation", "deferral")
INTERACTION_TYPES = (
    "view", "like", "share", "comment", "search", "create", "edit", "delete", "bookmark", "follow",
)
DEVICE_TYPES = ("mobile", "desktop", "tablet", "unknown")
METRIC_TYPES = (
    "cpu_usage", "memory_usage", "response_time", "error_rate", "throughput", "disk_usage", "network_io",
)
PROCESSING_STATUSES = ("pending", "in_progress", "completed", "failed", "cancelled")


INT, LONG, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
STR, BOOL, TIME = T.StringType(), T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(STR)
STRING_MAP = T.MapType(STR, STR)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


IDEAS = _struct(
    idea_id=INT, title=STR, description=STR, category=STR, status=STR, user_id=STR, user_name=STR,
    vote_count=LONG, average_rating=DOUBLE, view_count=LONG, tags=STRINGS, created_at=TIME,
    published_at=TIME,
)
COMMENTS = _struct(
    comment_id=LONG, idea_id=INT, user_id=STR, content=STR, is_deleted=BOOL, created_at=TIME,
)
VOTES = _struct(
    vote_id=LONG, idea_id=INT, user_id=STR, vote_type=STR, rating=DOUBLE, ip_address=STR,
    user_agent=STR, created_at=TIME, updated_at=TIME,
)
DECISIONS = _struct(
    id=LONG, decision_id=STR, idea_id=INT, decision_type=STR, status=STR, decided_by=STR,
    decision_committee=STRINGS, summary=STR, rationale=STR, conditions=STRINGS, metrics_snapshot=STR,
    score_threshold=DOUBLE, implementation_plan=STR, timeline_days=INT, created_at=TIME,
    decided_at=TIME, implemented_at=TIME,
)
DECISION_EVENTS = _struct(
    event_id=STR, decision_id=LONG, event_type=STR, event_data=STR, actor_id=STR, actor_name=STR,
    actor_role=STR, occurred_at=TIME,
)
DECISION_CRITERIA = _struct(
    criteria_id=INT, name=STR, category=STR, min_vote_count=INT, min_engagement_score=DOUBLE,
    min_average_rating=DOUBLE, max_controversy_score=DOUBLE, min_days_since_created=INT,
    max_days_in_review=INT, min_success_probability=DOUBLE, required_cluster_size=INT,
    suggested_decision_type=STR, auto_approve=BOOL, is_active=BOOL,
)

# The record on the vote topic. Ratings are DOUBLE so that averages do not drift.
VOTE_EVENT = _struct(
    event_id=STR, event_type=STR, idea_id=INT, user_id=STR, vote_type=STR, rating=DOUBLE,
    timestamp=TIME, ip_address=STR, user_agent=STR,
)

_ENVELOPE = {"event_type": STR, "event_id": STR, "timestamp": TIME, "producer_id": STR, "version": STR}

# One record schema per value of ``event_type``.
EVENT_SCHEMAS: dict[str, T.StructType] = {
    "user_interaction": _struct(
        **_ENVELOPE, user_id=STR, interaction_type=STR, content_id=STR, session_id=STR, device_type=STR,
        ip_address=STR, user_agent=STR, duration_ms=LONG, metadata=STRING_MAP,
    ),
    "thought_capture": _struct(
        **_ENVELOPE, user_id=STR, thought_id=STR, thought_text=STR, sentiment_score=DOUBLE, tags=STRINGS,
        word_count=INT, character_count=INT, language=STR, is_private=BOOL,
    ),
    "system_metric": _struct(
        **_ENVELOPE, metric_name=STR, metric_value=DOUBLE, component=STR, host=STR, environment=STR,
        unit=STR, metadata=STRING_MAP,
    ),
    "recommendation_generated": _struct(
        **_ENVELOPE, user_id=STR, recommended_content=STRINGS, algorithm=STR, confidence_score=DOUBLE,
        content_count=INT, feedback_score=DOUBLE,
    ),
    "user_session": _struct(
        **_ENVELOPE, session_id=STR, user_id=STR, start_time=TIME, end_time=TIME, device_type=STR,
        page_views=INT, interactions=INT, duration_seconds=LONG,
    ),
    "content": _struct(
        **_ENVELOPE, content_id=STR, title=STR, content_type=STR, author_id=STR, description=STR, url=STR,
        view_count=LONG, like_count=LONG, tags=STRINGS,
    ),
    "user": _struct(
        **_ENVELOPE, user_id=STR, email=STR, username=STR, is_active=BOOL,
    ),
}

# The topic each produced event goes to, and the field its message key is taken from.
EVENT_TOPICS = {
    "user_interaction": ("user-interactions", "user_id"),
    "thought_capture": ("thought-captures", "user_id"),
    "system_metric": ("system-metrics", "component"),
    "recommendation_generated": ("recommendations", "user_id"),
}

# ETL inputs.
INTERACTIONS = _struct(
    user_id=STR, timestamp=TIME, interaction_type=STR, content_id=STR, session_start=TIME,
    session_end=TIME, engagement_score=DOUBLE,
)
THOUGHTS = _struct(
    user_id=STR, thought_text=STR, timestamp=TIME, sentiment_score=DOUBLE, tags=STRINGS,
    metadata=_struct(source=STR, language=STR),
)
METRICS = _struct(
    metric_name=STR, metric_value=DOUBLE, timestamp=TIME, component=STR,
)
