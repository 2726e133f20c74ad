"""Confidence of facts: corroboration, decay and support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 60.0
CAP = 0.99


def is_proved(extractor: Column) -> Column:
    """Whether a fact was extracted by a deterministic rule or derived by one; these never decay. Case is ignored."""
    return F.lower(extractor).rlike("^(det|der):")


def tier(extractor: Column) -> Column:
    low = F.lower(extractor)
    return F.when(low.startswith("det:"), "det").when(low.startswith("der:"), "der").otherwise("inferred")


def effective(confidence: Column, created_at: Column, now: Column, extractor: Column) -> Column:
    """Confidence as of ``now``: what was inferred halves every 60 days; the rest, and what lacks a time or an extractor, stays."""
    days = F.expr("0").cast("double") + F.timestamp_diff("SECOND", created_at, now) / F.lit(86400.0)
    decayed = F.round(confidence * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), days) / F.lit(HALF_LIFE_DAYS)), 4)
    return F.when(extractor.isNull() | is_proved(extractor) | created_at.isNull() | now.isNull(), confidence).otherwise(decayed)


def corroborated(old: Column, new: Column) -> Column:
    """Three tenths of the way from the better one to certainty, at most 0.99."""
    best = F.greatest(old, new)
    return F.round(F.least(F.lit(CAP), best + (F.lit(1.0) - best) * F.lit(0.3)), 4)


def from_support(count: Column) -> Column:
    """Confidence of a coupling seen so many times."""
    return F.round(F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.05) * count), 4)
