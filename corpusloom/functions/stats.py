"""Intervals, verdicts and p-values as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(correct: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % Wilson interval of a proportion, clamped to [0, 1]; null for no trials."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = correct / n
    denom = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denom
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return F.when(n > 0, F.greatest(F.lit(0.0), center - margin)), F.when(n > 0, F.least(F.lit(1.0), center + margin))


def relative_difference(real: Column, other: Column) -> Column:
    """Percent; null where the real value is 0."""
    return F.abs(real - other) / F.nullif(F.abs(real), F.lit(0.0)) * 100


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by the rational approximation of Abramowitz and Stegun 26.2.17 (error under 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return poly * F.exp(-z * z / 2) / 2.5066282746310002


def verdict(value: Column, steps: list[tuple[float, str]], other: str) -> Column:
    """The name of the first step that the value is under."""
    out = F.lit(other)
    for limit, name in reversed(steps):
        out = F.when(value < limit, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def tokens_per_second(count: Column, nanoseconds: Column) -> Column:
    """Rounded half-even to one decimal; a missing or zero duration counts as 1 ns."""
    return F.bround(count / (F.coalesce(F.nullif(nanoseconds, F.lit(0)), F.lit(1)) / 1e9), 1)
