"""Fast and soft filters of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import languages, paths, scoring, severity


def fast(rows: DataFrame) -> DataFrame:
    """Without findings in test or generated code."""
    return rows.filter(~paths.is_test(F.col("file")) & ~paths.is_generated(F.col("file")))


def soft(rows: DataFrame, config: dict | None = None) -> DataFrame:
    """Test code steps down one severity and needs review (or is dropped); generated code is suppressed; the rest stays.

    Adds original_severity, context, triage_status, is_suppressed and, where scoring
    is on, confidence_score, at or under 0.5 (or the minimum) of which needs review.
    """
    config = {"enabled": True, "test_code": "reduce", "confidence_scoring": {}} | (config or {})
    if not config["enabled"]:
        return rows
    scored = config["confidence_scoring"]
    test, made = paths.is_test(F.col("file")), paths.is_generated(F.col("file"))
    if config["test_code"] == "skip":
        rows = rows.filter(~test)
    score = scoring.confidence_score(F.col("confidence"), F.col("n_steps")) if scored.get("enabled") else F.lit(None).cast("double")
    least = max(0.5, scored.get("minimum_score", 0.5))
    status = F.when(made, "false-positive").when(test, "needs-review").when(score <= least, "needs-review").otherwise("active")
    return (
        rows.withColumn("original_severity", F.when(test, F.col("severity")))
        .withColumn("severity", F.when(test, severity.reduced(F.col("severity"))).otherwise(F.col("severity")))
        .withColumn("context", F.when(test, "test_code"))
        .withColumn("triage_status", status)
        .withColumn("is_suppressed", F.col("is_suppressed") | made if "is_suppressed" in rows.columns else made)
        .withColumn("confidence_score", score)
    )


def of_languages(rows: DataFrame, wanted: str, detected: list[str]) -> DataFrame:
    """Files of the wanted language, ``auto`` being all that was detected."""
    names = languages.selected(F.lit(wanted), F.array(*[F.lit(x) for x in detected]).cast("array<string>"))
    return rows.withColumn("language", paths.language(F.col("file"))).filter(F.array_contains(names, F.col("language")))


def changed_only(rows: DataFrame, changed: DataFrame) -> DataFrame:
    return rows.join(changed, "file", "left_semi")


def focused(rows: DataFrame, level: str) -> DataFrame:
    """Exactly this severity, not those above."""
    return rows.filter(F.col("severity") == level)


def unfixed_high(rows: DataFrame) -> DataFrame:
    open_ = ~F.col("is_suppressed") & (F.col("status") != "false-positive")
    return rows.agg(F.count_if(open_ & severity.at_least(F.col("severity"), "high")).alias("unfixed_high"))
