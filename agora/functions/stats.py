"""Closed-form statistics on aggregated columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from agora.functions.scores import ColumnOrName, _c


def two_proportion_z(
    hits_a: ColumnOrName, total_a: ColumnOrName, hits_b: ColumnOrName, total_b: ColumnOrName
) -> Column:
    """z statistic of rate b against rate a with a pooled variance; null where it is undefined."""
    rate_a, rate_b = _c(hits_a) / _c(total_a), _c(hits_b) / _c(total_b)
    pooled = (_c(hits_a) + _c(hits_b)) / (_c(total_a) + _c(total_b))
    variance = pooled * (1 - pooled) * (F.lit(1.0) / _c(total_a) + F.lit(1.0) / _c(total_b))
    return F.when(
        (_c(total_a) > 0) & (_c(total_b) > 0) & (variance > 0), (rate_b - rate_a) / F.sqrt(variance)
    )


def erf(x: Column) -> Column:
    """Error function after Abramowitz and Stegun 7.1.26 (absolute error below 1.5e-7)."""
    # Coefficients of the approximation.
    p = 0.3275911
    a1, a2, a3, a4, a5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    t = F.lit(1.0) / (F.abs(x) * p + 1.0)
    poly = ((((t * a5 + a4) * t + a3) * t + a2) * t + a1) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def two_sided_confidence(z: ColumnOrName) -> Column:
    """Probability mass of a standard normal within +-|z|."""
    return erf(F.abs(_c(z)) / F.sqrt(F.lit(2.0)))


def growth(current: ColumnOrName, previous: ColumnOrName) -> Column:
    """Relative change; from zero it is 1.0 if anything came, else 0.0."""
    return F.when(
        _c(previous) == 0, F.when(_c(current) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    ).otherwise((_c(current) - _c(previous)) / _c(previous))


def trend_name(growth_rate: ColumnOrName, tolerance: float = 0.1) -> Column:
    return (
        F.when(_c(growth_rate) > tolerance, "rising")
        .when(_c(growth_rate) < -tolerance, "declining")
        .otherwise("stable")
    )
