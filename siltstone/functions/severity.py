"""Ordinal severity. Strings are never compared; ranks are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From least to most severe.
ORDER = ("info", "low", "medium", "high", "critical")


def _case(value: Column, pairs: dict, otherwise: Column | None = None) -> Column:
    out = None
    for key, result in pairs.items():
        out = F.when(value == key, F.lit(result)) if out is None else out.when(value == key, F.lit(result))
    return out.otherwise(otherwise)


def rank(severity: Column) -> Column:
    """info 0 to critical 4; anything else NULL."""
    return _case(F.lower(severity), {s: k for k, s in enumerate(ORDER)})


def from_rank(value: Column) -> Column:
    return _case(value, dict(enumerate(ORDER)))


def at_least(severity: Column, threshold: str) -> Column:
    return rank(severity) >= ORDER.index(threshold)


def reduced(severity: Column) -> Column:
    """One step down, info staying info; unknown values stay."""
    return F.coalesce(from_rank(F.greatest(rank(severity) - 1, F.lit(0))), severity)


def from_level(level: Column) -> Column:
    """SARIF levels. ``note`` and ``none`` are our choice; unknown levels are medium."""
    return _case(F.lower(level), {"error": "high", "warning": "medium", "note": "low", "none": "info"}, F.when(level.isNotNull(), F.lit("medium")))


def from_score(score: Column) -> Column:
    """Numeric security severity by the bands of CVSS: 9, 7, 4 and above 0."""
    value = score.try_cast("double")
    return F.when(value >= 9, "critical").when(value >= 7, "high").when(value >= 4, "medium").when(value > 0, "low").when(value == 0, "info")


def from_eslint(level: Column) -> Column:
    """2 is high; 1 is medium by our choice."""
    return F.when(level >= 2, "high").when(level == 1, "medium").otherwise("info")
