"""Vote, engagement and decision scores as column expressions.

Every function takes columns (or their names) and returns a column, so the same
formula serves batch jobs, streams and tests, and stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(value: ColumnOrName | float | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


# Weight and saturation point of each part of the capped engagement scores.
ENGAGEMENT_PROFILES: dict[str, dict[str, tuple[float, float]]] = {
    "analytics": {
        "vote_count": (0.3, 100.0),
        "average_rating": (0.25, 5.0),
        "view_count": (0.2, 1000.0),
        "comment_count": (0.15, 50.0),
        "days_active": (0.1, 30.0),
    },
    "voting": {
        "vote_count": (0.3, 50.0),
        "average_rating": (0.25, 5.0),
        "view_count": (0.2, 500.0),
        "comment_count": (0.15, 20.0),
    },
    "ideas": {
        "vote_count": (0.4, 50.0),
        "average_rating": (0.3, 5.0),
        "view_count": (0.2, 500.0),
        "comment_count": (0.1, 20.0),
    },
}
RECENCY_WEIGHT, RECENCY_DAYS, RECENCY_FLOOR = 0.1, 30.0, 0.5


def ratio(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """``part / whole``, 0.0 where ``whole`` is not positive."""
    return F.when(_c(whole) > 0, _c(part) / _c(whole)).otherwise(F.lit(0.0))


def net_votes(up: ColumnOrName, down: ColumnOrName) -> Column:
    return _c(up) - _c(down)


def discussion_engagement(total_votes: ColumnOrName, comments: ColumnOrName) -> Column:
    """Votes plus twice the comments."""
    return _c(total_votes) + _c(comments) * 2


def vote_engagement(up: ColumnOrName, ratings: ColumnOrName, down: ColumnOrName) -> Column:
    """Two points per upvote, one and a half per rating, minus one per downvote."""
    return _c(up) * 2 + _c(ratings) * 1.5 - _c(down)


def controversy(down: ColumnOrName, total: ColumnOrName, rating_stddev: ColumnOrName) -> Column:
    """Downvote share times rating spread; 0.0 up to ten votes."""
    return F.when(_c(total) > 10, _c(down) / _c(total) * _c(rating_stddev)).otherwise(F.lit(0.0))


def polarisation(up: ColumnOrName, down: ColumnOrName, rating_variance: ColumnOrName) -> Column:
    """Closeness of the vote split (70 %) and population variance of ratings (30 %)."""
    spread = F.least(F.coalesce(_c(rating_variance), F.lit(0.0)) / 4.0, F.lit(1.0))
    split = F.least(_c(up), _c(down)) / (_c(up) + _c(down))
    return F.when(_c(up) + _c(down) > 0, split * 0.7 + spread * 0.3).otherwise(F.lit(0.0))


def positivity(up: ColumnOrName, down: ColumnOrName) -> Column:
    """Upvotes per downvote; the upvotes themselves where there are no downvotes."""
    return F.when(_c(down) > 0, _c(up) / _c(down)).otherwise(_c(up).cast("double"))


def activity_level(*counters: ColumnOrName) -> Column:
    """``high`` above 50 actions in total, ``medium`` above 10, else ``low``."""
    total = reduce(lambda a, b: a + b, [_c(c) for c in counters])
    return F.when(total > 50, "high").when(total > 10, "medium").otherwise("low")


def user_score(
    ideas: ColumnOrName, implemented: ColumnOrName, votes: ColumnOrName, comments: ColumnOrName
) -> Column:
    """Contribution points: 10 per idea, 50 per implemented idea, 1 per vote, 2 per comment."""
    return _c(ideas) * 10 + _c(implemented) * 50 + _c(votes) + _c(comments) * 2


def author_engagement(ideas: ColumnOrName, votes: ColumnOrName) -> Column:
    return _c(ideas) * 5 + _c(votes)


def trending(
    up: ColumnOrName, ratings: ColumnOrName, down: ColumnOrName, window_end: ColumnOrName, as_of: Column
) -> Column:
    """Vote engagement that decays by 10 % of an e-fold per hour since the window closed."""
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(_c(window_end))) / F.lit(3600.0)
    return vote_engagement(up, ratings, down) * F.exp(hours * -0.1)


def vote_score(
    up: ColumnOrName,
    down: ColumnOrName,
    total_votes: ColumnOrName,
    rating_count: ColumnOrName,
    average_rating: ColumnOrName,
) -> Column:
    """Net votes plus twice the rating sum; 0.0 without any up- or downvote.

    ``total_votes`` counts up- and downvotes only, so an idea that has nothing but
    ratings scores 0.0. That is the stored behaviour this library reproduces.
    """
    rated = F.when(_c(rating_count) > 0, _c(average_rating) * 2.0 * _c(rating_count)).otherwise(F.lit(0.0))
    return F.when(_c(total_votes) == 0, F.lit(0.0)).otherwise(
        (_c(up) - _c(down)).cast("double") + rated
    )


def capped_engagement(profile: str, metrics: Mapping[str, ColumnOrName]) -> Column:
    """Weighted sum of metrics, each scaled to its saturation point and capped at 1.

    The ``voting`` profile adds a recency part that needs ``days_since_created``.
    """
    parts = [
        F.least(F.coalesce(_c(metrics[name]), F.lit(0)) / F.lit(cap), F.lit(1.0)) * weight
        for name, (weight, cap) in ENGAGEMENT_PROFILES[profile].items()
    ]
    if profile == "voting":
        age = _c(metrics["days_since_created"]) / F.lit(RECENCY_DAYS)
        parts.append(F.greatest(1.0 - age, F.lit(RECENCY_FLOOR)) * RECENCY_WEIGHT)
    return reduce(lambda a, b: a + b, parts)


def review_engagement(votes: ColumnOrName, rating: ColumnOrName) -> Column:
    """Votes (60 %) and ratings on a scale of fifty (40 %)."""
    return _c(votes) * 0.6 + _c(rating) * 10 * 0.4


def roi(cost: ColumnOrName, revenue: ColumnOrName) -> Column:
    """Return on investment; null where nothing was invested."""
    return F.when(_c(cost) != 0, (_c(revenue) - _c(cost)) / _c(cost))


def adjusted_probability(probability: ColumnOrName, risk_factors: ColumnOrName) -> Column:
    """Five points off per risk factor, never below ten percent."""
    return F.greatest(_c(probability) - F.size(_c(risk_factors)) * 0.05, F.lit(0.1))


def expected_value(
    cost: ColumnOrName, revenue: ColumnOrName, probability: ColumnOrName, risk_factors: ColumnOrName
) -> Column:
    return (_c(revenue) - _c(cost)) * adjusted_probability(probability, risk_factors)


def risk_level(risk_factors: ColumnOrName) -> Column:
    count = F.size(_c(risk_factors))
    return F.when(count > 2, "high").when(count > 0, "medium").otherwise("low")


def success_likelihood(probability: ColumnOrName) -> Column:
    return F.when(_c(probability) > 0.7, "High").when(_c(probability) > 0.4, "Medium").otherwise("Low")


def quality_score(completeness: ColumnOrName, accuracy: ColumnOrName, consistency: ColumnOrName) -> Column:
    return F.round(_c(completeness) * 0.4 + _c(accuracy) * 0.4 + _c(consistency) * 0.2, 3)


def popular_label(up: ColumnOrName, up_ratio: ColumnOrName) -> Column:
    """1.0 for at least ten upvotes at a ratio of 0.7 or more."""
    return F.when((_c(up) >= 10) & (_c(up_ratio) >= 0.7), 1.0).otherwise(0.0)


def success_label(status: ColumnOrName, engagement: ColumnOrName, mean_engagement: Column) -> Column:
    """1 for implemented ideas and for engagement above twice the overall mean."""
    return F.when((_c(status) == "implemented") | (_c(engagement) > mean_engagement * 2), 1).otherwise(0)


def page_count(total: ColumnOrName, page_size: int) -> Column:
    return F.floor((_c(total) + (page_size - 1)) / page_size)


def vote_weight(is_expert: ColumnOrName, expert_weight: float = 1.5) -> Column:
    return F.when(F.coalesce(_c(is_expert), F.lit(False)), expert_weight).otherwise(1.0)


def volume_score(vote_count: ColumnOrName, scale: float) -> Column:
    """Vote count (text allowed) over a fixed scale; used for imports and chunked scoring."""
    return _c(vote_count).cast("int") / F.lit(scale)


def net_rate(up: ColumnOrName, down: ColumnOrName, scale: float = 20.0) -> Column:
    """Net votes over a fixed scale, the score shown next to synchronised totals."""
    return (_c(up) - _c(down)) / F.lit(scale)
