"""Baseline, suppressions and audit: tables that a step turns into new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import versions
from siltstone.schemas import BASELINE


def keys(findings: DataFrame) -> DataFrame:
    """Both fingerprints of all findings, each once, without empty ones."""
    each = findings.select(F.explode(F.array("fingerprint", "fingerprint_v1")).alias("fingerprint"))
    return each.filter("fingerprint is not null and fingerprint != ''").distinct()


def created(findings: DataFrame, at: Column) -> DataFrame:
    return keys(findings).withColumn("first_seen", at)


def updated(baseline: DataFrame, findings: DataFrame, at: Column) -> DataFrame:
    """New keys join; the earliest first_seen of a key stays."""
    new = keys(findings).withColumn("now", at)
    return baseline.join(new, "fingerprint", "full").select("fingerprint", F.least("first_seen", "now").alias("first_seen"))


def marked(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds is_new: the fingerprint is not in the baseline."""
    known = baseline.select(F.col("fingerprint").alias("_k")).distinct()
    return findings.join(known, F.col("fingerprint") == F.col("_k"), "left").withColumn("is_new", F.col("_k").isNull()).drop("_k")


def new_only(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def active(expires_at: Column, as_of: Column) -> Column:
    """A suppression without end, or one whose last day (included, by our choice) has not passed."""
    return expires_at.isNull() | (expires_at >= as_of)


def suppressed(findings: DataFrame, suppressions: DataFrame, as_of: Column) -> DataFrame:
    """Adds is_suppressed and suppression_reason from active suppressions."""
    live = current(suppressions).filter(active(F.col("expires_at"), as_of)).select(F.col("fingerprint").alias("_k"), F.col("reason").alias("suppression_reason"))
    out = findings.drop("is_suppressed", "suppression_reason").join(live, F.col("fingerprint") == F.col("_k"), "left")
    return out.withColumn("is_suppressed", F.col("_k").isNotNull()).drop("_k")


def current(suppressions: DataFrame) -> DataFrame:
    """The last write of each fingerprint, by seq."""
    last = Window.partitionBy("fingerprint").orderBy(F.col("seq").desc())
    return suppressions.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def with_audit(audit: DataFrame, rows: DataFrame, action: str) -> DataFrame:
    """The trail with an entry for each row (fingerprint, seq)."""
    return audit.unionByName(rows.select("seq", F.lit(action).alias("action"), "fingerprint"))


def add(suppressions: DataFrame, more: DataFrame) -> DataFrame:
    return current(suppressions.unionByName(more))


def remove(suppressions: DataFrame, fingerprints: DataFrame) -> DataFrame:
    return suppressions.join(fingerprints, "fingerprint", "left_anti")


def imported(suppressions: DataFrame, more: DataFrame) -> DataFrame:
    """Each row of ``more`` with outcome imported or skipped; one without a key is neither."""
    first = Window.partitionBy("fingerprint").orderBy("seq")
    rows = more.filter("fingerprint is not null and fingerprint != ''").withColumn("_n", F.row_number().over(first))
    known = suppressions.select(F.col("fingerprint").alias("_k")).distinct()
    out = rows.join(known, F.col("fingerprint") == F.col("_k"), "left")
    return out.withColumn("outcome", F.when(F.col("_k").isNull() & (F.col("_n") == 1), "imported").otherwise("skipped")).drop("_k", "_n")


def cleaned(suppressions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): expired suppressions go."""
    live = active(F.col("expires_at"), as_of)
    return suppressions.filter(live), suppressions.filter(~live)


def stats(suppressions: DataFrame, as_of: Column) -> DataFrame:
    permanent = F.col("expires_at").isNull()
    return suppressions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~active(F.col("expires_at"), as_of)).alias("expired"),
        F.count_if(permanent).alias("permanent"),
        F.count_if(active(F.col("expires_at"), as_of)).alias("active"),
    )


def shown(baseline: DataFrame, suppressions: DataFrame) -> DataFrame:
    """One row: fingerprints and suppressions in a baseline."""
    return baseline.agg(F.count(F.lit(1)).alias("fingerprints")).crossJoin(suppressions.agg(F.count(F.lit(1)).alias("suppressions")))


def diff(before: DataFrame, after: DataFrame, key: str = "fingerprint") -> DataFrame:
    """(key, change): added, removed or unchanged."""
    a = before.select(key).distinct().withColumn("_a", F.lit(True))
    b = after.select(key).distinct().withColumn("_b", F.lit(True))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def diff_all(before: DataFrame, after: DataFrame, held_before: DataFrame, held_after: DataFrame) -> DataFrame:
    """(kind, fingerprint, change) of two baselines: their fingerprints, and their suppressions."""
    return diff(before, after).select(F.lit("fingerprint").alias("kind"), "fingerprint", "change").unionByName(diff(held_before, held_after).select(F.lit("suppression").alias("kind"), "fingerprint", "change"))


def audit_trail(audit: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first."""
    return audit.orderBy(F.col("seq").desc()).limit(limit)


def create(spark: SparkSession, folder: str, findings: DataFrame, at: Column) -> int:
    """Save the fingerprints of findings as a baseline that starts anew; its version."""
    return versions.commit(spark, folder, BASELINE, lambda known: created(findings, at).select("fingerprint", "first_seen"))


def update(spark: SparkSession, folder: str, findings: DataFrame, at: Column) -> int:
    """Bring the saved baseline up to date; its version. Of two updates at once both are in it at the end, and one cut off changes nothing."""
    return versions.commit(spark, folder, BASELINE, lambda known: updated(known, findings, at))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline saved last; one without fingerprints where there is none."""
    return versions.read(spark, folder, BASELINE)
