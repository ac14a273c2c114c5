"""Scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom import config as C


def decay(days: Column, kind: Column) -> Column:
    """(1 + days) ** -f; an unknown kind decays as ambient, a missing age is 0."""
    rate = F.lit(C.DECAY["ambient"])
    for name, f in C.DECAY.items():
        rate = F.when(kind == name, F.lit(f)).otherwise(rate)
    return F.when(days.isNull(), F.lit(0.0)).otherwise(F.pow(1 + F.greatest(days, F.lit(0.0)), -rate))


def freshness(days: Column) -> Column:
    return F.when(days <= C.FRESH_DAYS, "fresh").otherwise("stale")


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def content_mass(text: Column) -> Column:
    """min(1, log2(distinct words + 1) / 6)."""
    words = F.size(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: t != "")))
    return F.least(F.lit(1.0), F.log2(words + 1) / 6)


def feedback_score(total: Column) -> Column:
    """2 (sigmoid(0.6 s) - 0.5) for s > 0, else 0."""
    return F.when(total > 0, 2 * (1 / (1 + F.exp(-C.FEEDBACK_STEEPNESS * total)) - 0.5)).otherwise(F.lit(0.0))


def engagement_recency(days: Column) -> Column:
    span = C.ENGAGE_FLOOR_DAYS - C.ENGAGE_FULL_DAYS
    falling = 1 - (1 - C.ENGAGE_FLOOR) * (days - C.ENGAGE_FULL_DAYS) / span
    return F.when(days <= C.ENGAGE_FULL_DAYS, F.lit(1.0)).when(days >= C.ENGAGE_FLOOR_DAYS, F.lit(C.ENGAGE_FLOOR)).otherwise(falling)
