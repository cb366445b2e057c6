"""Null-safe arithmetic on columns. A missing or impossible input gives null, never NaN, infinity or an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def forward_variance(iv_near: Column, days_near: Column, iv_far: Column, days_far: Column) -> Column:
    """Annual variance between two tenors from volatilities in points; a negative one is kept, equal tenors give null."""
    near, far = days_near / 365, days_far / 365
    total = far * F.pow(iv_far / 100, F.lit(2.0)) - near * F.pow(iv_near / 100, F.lit(2.0))
    return F.when(far != near, total / (far - near))


def forward_volatility(variance: Column) -> Column:
    """Points of volatility; null for a negative variance."""
    return F.when(variance >= 0, F.sqrt(variance) * 100)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def logit(p: Column, floor: float = 1e-6) -> Column:
    q = clipped(p, floor, 1 - floor)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def weighted_score(parts: Sequence[tuple[Column, float]]) -> Column:
    """Sum of 100 * weight * part; null if any part is, weights are not spread over the rest."""
    total = F.lit(0.0)
    for part, weight in parts:
        total = total + part * (100 * weight)
    return total


def bucket(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the left-closed interval that x falls in; names has one more than edges; null stays null."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(x < edge, F.lit(name)).otherwise(out)
    return F.when(x.isNotNull(), out)


def same(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal within the tolerance, or both missing."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) | (a.isNull() & b.isNull())


def scaled_change(d: Column) -> Column:
    """A change of -100..100 points mapped onto 0..1."""
    return clipped((d + 100) / 200, 0.0, 1.0)


def capped_log_age(age: Column, cap: int = 20) -> Column:
    return F.log1p(F.when(age.isNotNull(), F.least(age, F.lit(cap))).cast("double"))
