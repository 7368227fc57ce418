"""Shared scoring expressions: thresholds to status, scores to bands, half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claritable import rules


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def at_least(value: Column, pass_min, warn_min) -> Column:
    return F.when(value >= pass_min, "pass").when(value >= warn_min, "warn").otherwise("fail")


def at_most(value: Column, pass_max, warn_max) -> Column:
    return F.when(value <= pass_max, "pass").when(value <= warn_max, "warn").otherwise("fail")


def status_rank(status: Column) -> Column:
    return F.when(status == "pass", 2).when(status == "warn", 1).otherwise(0)


def points(status: Column) -> Column:
    chain = F
    for name, value in rules.STATUS_POINTS.items():
        chain = chain.when(status == name, F.lit(value))
    return chain.otherwise(F.lit(rules.STATUS_POINTS["fail"]))


def band(score: Column, bands, lowest: str) -> Column:
    chain = F
    for name, minimum in bands:
        chain = chain.when(score >= minimum, F.lit(name))
    return chain.otherwise(F.lit(lowest))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, half-even, 0 for an empty whole."""
    return F.bround(ratio(part, whole) * 100, 2)


def whole_score(c: Column) -> Column:
    return F.bround(c, 0).cast("int")
