"""Decay, retention, priority, validity and feedback as Column expressions. `now` is a column, never the wall clock."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the scoring functions.
HALF_LIFE, FLOOR = 168.0, 0.1
SEMANTIC, RECENCY = 0.8, 0.2
TYPE_WEIGHTS = {"decision": 1.0, "error": 0.9, "dead_end": 0.85, "pattern": 0.8, "learning": 0.7, "observation": 0.5}
BOOST_TAGS = "(?i)^(critical|architecture|security)$"


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600.0


def exponential_decay(hours: Column, half_life: float = HALF_LIFE, floor: float = FLOOR) -> Column:
    return F.when(hours <= 0, 1.0).otherwise(F.greatest(F.lit(floor), F.exp(F.lit(-math.log(2) / half_life) * hours)))


def linear_decay(hours: Column, most: float = 2 * HALF_LIFE, floor: float = FLOOR) -> Column:
    return F.when(hours <= 0, 1.0).when(hours >= most, floor).otherwise(F.greatest(F.lit(floor), 1.0 - hours / most * (1.0 - floor)))


def access_boost(count: Column, factor: float = 0.05, most: float = 0.3) -> Column:
    return F.when(count <= 0, 0.0).otherwise(F.least(count * factor, F.lit(most)))


def temporal_score(similarity: Column, hours: Column, count: Column) -> Column:
    return SEMANTIC * similarity + RECENCY * F.least(F.lit(1.0), exponential_decay(hours) + access_boost(count))


def valid_closed(start: Column, end: Column, at: Column) -> Column:
    """start <= at <= end, null is open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def valid_half_open(created: Column, start: Column, end: Column, at: Column) -> Column:
    """As of a time: created by then, started by then, and not ended by then."""
    return (created <= at) & (start.isNull() | (start <= at)) & (end.isNull() | (end > at))


def effective_score(quality: Column, age_days: Column, count: Column) -> Column:
    """Retention by hyperbolic recency and multiplied access, whose factor is tenths divided once: 1.0 + 0.1 * 7 would be one unit in the last place over 1.7."""
    return F.coalesce(quality, F.lit(0.5)) * (1.0 / (1.0 + 0.01 * age_days)) * F.least((10 + count) / 10.0, F.lit(2.0))


def effective_score_decayed(quality: Column, hours: Column, count: Column) -> Column:
    """The same by the temporal decay and boost of the ranking."""
    return F.coalesce(quality, F.lit(0.5)) * exponential_decay(hours) * (1.0 + access_boost(count))


def tier(score: Column) -> Column:
    return F.when(score >= 0.3, "keep").when(score >= 0.15, "warn").otherwise("delete")


def type_weight(kind: Column, tags: Column) -> Column:
    base = F.lit(0.5)
    for name, w in TYPE_WEIGHTS.items():
        base = F.when(F.coalesce(kind, F.lit("observation")) == name, w).otherwise(base)
    return F.when(F.exists(tags, lambda t: t.rlike(BOOST_TAGS)), F.least(base + 0.1, F.lit(1.0))).otherwise(base)


def decayed_confidence(quality: Column, hours: Column) -> Column:
    return F.coalesce(quality, F.lit(0.5)) * F.greatest(F.exp(F.lit(-math.log(2) / HALF_LIFE) * F.greatest(hours, F.lit(0.0))), F.lit(0.1))


def priority(invariant: Column, confidence: Column, corrections: Column, weight: Column, count: Column) -> Column:
    return 0.3 * F.when(invariant, 1.0).otherwise(0.0) + 0.25 * confidence + 0.2 * F.least(corrections, F.lit(5)) / 5 + 0.15 * weight + 0.1 * F.least(count, F.lit(20)) / 20


def feedback_factor(total: Column, rate: Column) -> Column:
    return F.when(total == 0, 1.0).when(total < 3, 0.95 + rate * 0.1).when(rate >= 0.8, 1.3).when(rate >= 0.6, 1.15).when(rate >= 0.4, 1.0).when(rate >= 0.2, 0.85).otherwise(0.7)


def quality_multiplier(similarity: Column, quality: Column) -> Column:
    return F.when(quality > 0, similarity * (1 - 0.15 + 0.15 * quality)).otherwise(similarity)


def position_weight(rank: Column) -> Column:
    """Access weight of a result by its 1-based rank."""
    return F.greatest(F.lit(0.5), 1.0 - 0.05 * (rank - 1))


def promoted(confidence: Column) -> Column:
    return F.greatest(F.coalesce(confidence, F.lit(0.5)), F.lit(0.75))


def degraded(confidence: Column, by: float = 0.1) -> Column:
    return F.greatest(F.coalesce(confidence, F.lit(0.5)) - by, F.lit(0.05))


def boosted(confidence: Column, by: float = 0.1) -> Column:
    return F.least(F.coalesce(confidence, F.lit(0.5)) + by, F.lit(0.95))


def parse_duration(text: str, start: Column) -> Column:
    """An ISO date, or a number of days, weeks, months or years forward from start; anything else is an error."""
    import re

    if found := re.fullmatch(r"(\d+)([dwmy])", text):
        n, unit = int(found[1]), found[2]
        return {"d": lambda: F.date_add(start, n), "w": lambda: F.date_add(start, 7 * n), "m": lambda: F.add_months(start, n), "y": lambda: F.add_months(start, 12 * n)}[unit]()
    if re.match(r"\d{4}-\d{2}-\d{2}", text):
        return F.lit(text).cast("timestamp")
    raise ValueError(f"not a duration or date: {text}")
