"""Scores in whole basis points, so that every engine rounds alike, and interval estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = 10_000


def ratio_half_up(num: Column, den: int) -> Column:
    """num / den, to the nearest whole number, halves up (num must not be negative)."""
    return F.floor((2 * num + den) / (2 * den)).cast("long")


def ramp(hours: Column, full: int, none: int) -> Column:
    """Basis points: ONE up to `full` hours, none from `none` hours, linear between."""
    return F.when(hours <= full, F.lit(ONE)).when(hours >= none, F.lit(0)).otherwise(ratio_half_up((none - hours) * ONE, none - full)).cast("long")


def contribution(points: Column, weight: int) -> Column:
    """Hundredths of a score that a component in basis points adds under a weight of 100."""
    return ratio_half_up(points * weight, 100)


def band(tenths: Column, edges: tuple[int, int] = (400, 700)) -> Column:
    return F.when(tenths < edges[0], F.lit("low")).when(tenths < edges[1], F.lit("mid")).otherwise(F.lit("high"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within 0 and 1; null for no trials."""
    p = k / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = ((f(centre, spread)) / (1 + z * z / n) for f in (lambda a, b: a - b, lambda a, b: a + b))
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def ratio(k: Column, n: Column) -> Column:
    return F.when(n > 0, k / n)
