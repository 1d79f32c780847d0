"""Ratios, weights and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points a finding costs by severity, times its confidence; and grades. Both are our choice.
WEIGHTS = {"critical": 15.0, "high": 8.0, "medium": 3.0, "low": 1.0, "info": 0.2}
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}
GRADES = ((95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D"))
#: Prior score by confidence, and a bonus for evidence; our choice.
PRIOR, TRACE_BONUS = {"high": 0.7, "medium": 0.5, "low": 0.3}, 0.2


def ratio(part: Column, whole: Column) -> Column:
    """0.0 where the denominator is zero."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _pick(value: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for key, number in table.items():
        out = F.when(value == key, F.lit(number)).otherwise(out)
    return out


def cost(severity: Column, confidence: Column) -> Column:
    return _pick(severity, WEIGHTS, 0.0) * _pick(confidence, CONFIDENCE, 0.7)


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def confidence_score(confidence: Column, steps: Column) -> Column:
    return F.least(F.lit(1.0), _pick(confidence, PRIOR, 0.5) + F.when(steps > 0, TRACE_BONUS).otherwise(0.0))


def percent(value: Column, signed: bool = False) -> Column:
    """One decimal and a percent sign, with a sign in front if asked."""
    return F.format_string("%+.1f%%" if signed else "%.1f%%", value * 100)
