"""Gate, triage, verdicts and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import severity, text

#: Base scores of risks; what a covered target loses; what each further risk adds. Our choice where a config says nothing.
RISKS = {"missing-authentication": 3.0, "idor-risk": 2.0, "business-logic": 1.5, "missing-csrf": 0.5}
COVERED, COMPOUND, FALSE_PATH = 2.0, 0.5, 2.0
STATUSES = ("active", "needs-review", "likely", "confirmed", "false-positive")


def gate(findings: DataFrame, fail_on: str = "high", review_findings_blocking: bool = False) -> DataFrame:
    """One row: blocking_count, review_only_count, passed and a count of each severity.

    Blocking are new, unsuppressed findings at the threshold or above, those that
    need review only if asked; review_only_count has the others of them.
    """
    open_ = F.col("is_new") & ~F.col("is_suppressed") & severity.at_least(F.col("severity"), fail_on)
    review = F.col("status") == "needs-review"
    blocks = open_ if review_findings_blocking else open_ & ~review
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in reversed(severity.ORDER)]
    rows = findings.agg(F.count_if(blocks).alias("blocking_count"), F.count_if(open_ & review).alias("review_only_count"), *counts)
    return rows.withColumn("passed", F.col("blocking_count") == 0)


def exit_code(gate_row: DataFrame) -> DataFrame:
    return gate_row.select(F.when(F.col("passed"), 0).otherwise(1).alias("exit_code"))


def bucket() -> Column:
    """priority, important, needs_review or false_positive; active medium findings are important by our choice."""
    rank = severity.rank(F.col("severity"))
    return (
        F.when((F.col("status") == "false-positive") | F.col("is_suppressed"), "false_positive")
        .when(F.col("status") == "needs-review", "needs_review")
        .when(rank >= 3, "priority")
        .when(rank >= 2, "important")
        .otherwise("needs_review")
    )


def buckets(findings: DataFrame) -> DataFrame:
    return findings.groupBy(bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def with_context(findings: DataFrame, files: DataFrame, around: int = 3) -> DataFrame:
    """Findings with their bucket and the lines around; files: (path, text), an unreadable one giving no lines."""
    rows = findings.withColumn("bucket", bucket()).join(files.select(F.col("path").alias("_path"), F.col("text").alias("_text")), F.col("file") == F.col("_path"), "left")
    return rows.withColumn("lines", text.context(F.col("_text"), F.col("start_line"), around)).drop("_path", "_text")


def priority_list(findings: DataFrame, key: str = "event_id") -> DataFrame:
    """Most severe first."""
    return findings.orderBy(severity.rank(F.col("severity")).desc(), F.col(key))


def with_verdicts(findings: DataFrame, verdicts: DataFrame, at: str) -> DataFrame:
    """TP confirms and FP rejects; findings without verdict keep their status."""
    known = verdicts.select(F.col("fingerprint").alias("_k"), "verdict", "verdict_confidence", "rationale")
    status = F.when(F.col("verdict") == "TP", "confirmed").when(F.col("verdict") == "FP", "false-positive").otherwise(F.col("status"))
    out = findings.join(known, F.col("fingerprint") == F.col("_k"), "left").withColumn("status", status)
    return out.withColumn("validated_at", F.when(F.col("_k").isNotNull(), F.lit(at))).drop("_k")


def exported(findings: DataFrame, min_confidence: float) -> DataFrame:
    """Findings to suppress: false positives of enough confidence."""
    return findings.filter((F.col("status") == "false-positive") & (F.col("verdict_confidence") >= min_confidence))


def fix_validation(before: DataFrame, after: DataFrame, fixed: DataFrame) -> DataFrame:
    """(resolved, new_findings_count) of a rescan; resolved if it has none of the fingerprints in ``fixed``."""
    new = after.select("fingerprint").distinct().join(before.select("fingerprint").distinct(), "fingerprint", "left_anti").agg(F.count(F.lit(1)).alias("new_findings_count"))
    left = fixed.select("fingerprint").join(after.select("fingerprint"), "fingerprint", "left_semi").agg((F.count(F.lit(1)) == 0).alias("resolved"))
    return left.crossJoin(new)


def prioritized(targets: DataFrame, findings: DataFrame, risks: dict[str, float] | None = None, fp_path: str = "/api/auth/") -> DataFrame:
    """Targets (target, file, risks) with their score, highest first; the caller limits.

    The highest base score of its risks, more for each further one, less on paths
    that are mostly false alarms and where findings cover the file already.
    """
    table = F.create_map(*[F.lit(x) for pair in (RISKS | (risks or {})).items() for x in pair])
    base = F.array_max(F.transform("risks", lambda r: F.coalesce(F.try_element_at(table, r), F.lit(1.0))))
    covered = findings.select("file").distinct().withColumn("_covered", F.lit(True))
    rows = targets.join(covered, "file", "left")
    score = base + F.lit(COMPOUND) * (F.size("risks") - 1) - F.when(F.col("file").contains(fp_path), FALSE_PATH).otherwise(0.0) - F.when(F.col("_covered"), COVERED).otherwise(0.0)
    return rows.withColumn("score", score).drop("_covered").orderBy(F.col("score").desc(), "target")


def numbered(targets: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` targets with ids T-001 and on."""
    top = targets.orderBy(*order).limit(limit)
    return top.withColumn("target_id", F.format_string("T-%03d", F.row_number().over(Window.orderBy(*order))))


def checklist(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """(target, file, to_analyze, skip): risks of a target that no finding of its file covers (file, risk)."""
    covered = findings.groupBy("file").agg(F.collect_set("risk").alias("covered"))
    rows = targets.join(covered, "file", "left")
    left = F.array_except("risks", F.coalesce("covered", F.array().cast("array<string>")))
    return rows.select("target", "file", F.array_sort(left).alias("to_analyze"), (F.size(left) == 0).alias("skip"))


def session_status(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """One row of scan_complete, pending_targets and unfixed_high."""
    open_ = ~F.col("is_suppressed") & (F.col("status") != "false-positive") & severity.at_least(F.col("severity"), "high")
    left = findings.agg((F.count(F.lit(1)) > 0).alias("scan_complete"), F.count_if(open_).alias("unfixed_high"))
    return left.crossJoin(targets.agg(F.count_if(~F.col("done")).alias("pending_targets")))


def sessions(scans: DataFrame, plans: DataFrame, findings: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row for each session_id that any input has: how far it came, and what is next.

    scans (session_id, profile) and plans (session_id, completed_phases, n_discover) have a row
    a session, analyses (session_id, n_validated, n_discovered) one for what a model gave
    back; findings (session_id, severity, status, is_suppressed) any number. A session
    without rows in one of them has nothing of that kind.
    """
    open_ = ~F.col("is_suppressed") & (F.col("status") != "false-positive") & severity.at_least(F.col("severity"), "high")
    left = findings.groupBy("session_id").agg(F.count_if(open_).alias("unfixed_high"))
    marked = lambda rows, name: rows.withColumn(name, F.lit(True))
    rows = marked(scans, "scanned").join(plans, "session_id", "full").join(left, "session_id", "full").join(marked(analyses, "analyzed"), "session_id", "full")
    number = lambda name: F.coalesce(name, F.lit(0)).cast("bigint")
    scanned, analyzed = F.coalesce("scanned", F.lit(False)), F.coalesce("analyzed", F.lit(False))
    phases = F.array_compact(F.array(F.when(scanned, "scan"), F.when(number("n_validated") > 0, "phase_a"), F.when(number("n_discovered") > 0, "phase_b")))
    rows = rows.select(
        "session_id", "profile", scanned.alias("scan_complete"), analyzed.alias("llm_findings_present"),
        F.greatest(number("n_discover") - number("n_discovered"), F.lit(0)).alias("pending_discover"), number("unfixed_high").alias("unfixed_high"),
        F.array_sort(F.array_union(F.coalesce("completed_phases", F.array().cast("array<string>")), phases)).alias("completed_phases"),
    )
    due = F.array_compact(
        F.array(
            F.when(~F.col("scan_complete"), "run a sast-scan"),
            F.when(F.col("pending_discover") > 0, "analyze the discover targets left"),
            F.when(F.col("unfixed_high") > 0, "triage and fix the high findings"),
        )
    )
    return rows.withColumn("next_steps", F.when(F.size(due) > 0, due).otherwise(F.array(F.lit("refresh the baseline"))))


def next_steps(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """(at, step): three steps for a scan, by what it found; with ``scans``, whose columns name one, three for each, also for clean ones."""
    by = scans.columns if scans is not None else []
    steps = ("fix blocking findings", "review findings that need it", "refresh the baseline", "scan changed-only in continuous integration", "update rules")
    n = findings.groupBy(*by).agg(F.count_if(severity.at_least(F.col("severity"), "high")).alias("high"), F.count_if(F.col("status") == "needs-review").alias("review"))
    all_steps = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(s).alias("step"), due.alias("due")) for k, (s, due) in enumerate(zip(steps, (F.col("high") > 0, F.col("review") > 0, F.lit(True), F.lit(True), F.lit(True)), strict=True))])
    if scans is not None:
        n = scans.distinct().join(n, by, "left").na.fill(0, ["high", "review"])
    return n.select(*by, F.explode(F.slice(F.filter(all_steps, lambda s: s["due"]), 1, 3)).alias("s")).select(*by, "s.at", "s.step")
