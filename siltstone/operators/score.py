"""Scoring of detections against ground truth, trends, compliance and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import paths, scoring, text

# Benchmark categories and the CWE ids accepted as a detection of each.
CATEGORY_CWES = {
    "cmdi": (77, 78),
    "crypto": (326, 327, 329),
    "hash": (327, 328, 916),
    "ldapi": (90,),
    "pathtraver": (22, 23, 36),
    "securecookie": (614, 1004),
    "sqli": (89,),
    "trustbound": (501,),
    "weakrand": (330, 336, 338),
    "xpathi": (643,),
    "xss": (79, 80),
}
# Controls and the CWEs they cover, as far as they are known.
CONTROLS = (
    ("soc2", "CC6.1 — Access Control", (22, 862, 863)),
    ("soc2", "CC6.6 — Injection", (78, 89)),
    ("soc2", "CC6.7 — Data Leakage", (798,)),
    ("pci-dss", "6.5.1 — Injection Flaws", (78, 89)),
    ("pci-dss", "6.5.2 — Default Credentials", (798,)),
    ("hipaa", "164.312(a) — Access Control", (862, 863)),
    ("nist800-53", "SC-13 — Cryptographic Protection", (328,)),
    ("nist800-53", "SI-10 — Input Validation", (78, 89, 22)),
)
METRICS = ("tpr", "fpr", "precision", "f1", "benchmark_score")


def categories(spark) -> DataFrame:
    return spark.createDataFrame([(c, list(v)) for c, v in CATEGORY_CWES.items()], "category string, accepted array<int>")


def detections(findings: DataFrame) -> DataFrame:
    """(name, found): CWE numbers reported for each case, by the name in the path; other paths fall out."""
    each = findings.select(paths.test_case(F.col("path")).alias("name"), F.explode_outer(text.cwe_numbers(F.col("cwe"))).alias("n")).filter("name is not null")
    return each.groupBy("name").agg(F.array_sort(F.collect_set("n")).alias("found"))


def outcomes(truth: DataFrame, found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Truth with ``detected``: reported CWEs meet those accepted for its category, else its own."""
    rows = truth.join(accepted, "category", "left").join(found, "name", "left")
    hit = F.arrays_overlap(F.coalesce("found", F.array().cast("array<int>")), F.coalesce("accepted", F.array("cwe")))
    return rows.withColumn("detected", F.coalesce(hit, F.lit(False)))


def counts(rows: DataFrame, *by: str, real: str = "real", detected: str = "detected") -> DataFrame:
    r, d = F.col(real), F.col(detected)
    out = rows.groupBy(*by) if by else rows.groupBy()
    return out.agg(F.count_if(r & d).alias("tp"), F.count_if(~r & d).alias("fp"), F.count_if(~r & ~d).alias("tn"), F.count_if(r & ~d).alias("fn"))


def derived(rows: DataFrame) -> DataFrame:
    """Ratios of tp, fp, tn and fn, 0.0 where undefined."""
    tpr, fpr = scoring.ratio(F.col("tp"), F.col("tp") + F.col("fn")), scoring.ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    precision = scoring.ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    out = rows.withColumns({"tpr": tpr, "fpr": fpr, "precision": precision})
    out = out.withColumn("f1", scoring.ratio(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr")))
    return out.withColumns({"benchmark_score": F.col("tpr") - F.col("fpr"), "total": F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")})


def every_category(rows: DataFrame, all_of: DataFrame, key: str = "category") -> DataFrame:
    """Zero counts for categories without rows."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "tn", "fn")}
    return all_of.select(key).join(rows, key, "left").withColumns(zero)


def overall(per: DataFrame) -> DataFrame:
    """(scope, ..): ratios of the summed counts, over all categories and over those with a detection (none: no row)."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]
    whole = per.agg(*sums).select(F.lit("all").alias("scope"), "*")
    covered = per.filter("tp + fp > 0").agg(*sums).filter("tp is not null").select(F.lit("covered").alias("scope"), "*")
    return derived(whole.unionByName(covered))


# Trends over scans: facts are (scan_date, key).


def scans(facts: DataFrame) -> DataFrame:
    return facts.select("scan_date", "key").distinct()


def spells(facts: DataFrame) -> DataFrame:
    """Facts with the scan before and after theirs, and whether the key was, or will be, there."""
    once = scans(facts)
    days = once.select("scan_date").distinct()
    w = Window.orderBy("scan_date")
    days = days.select("scan_date", F.lag("scan_date").over(w).alias("previous"), F.lead("scan_date").over(w).alias("next"))
    own = Window.partitionBy("key").orderBy("scan_date")
    rows = once.join(days, "scan_date").withColumns({"seen_before": F.lag("scan_date").over(own), "seen_after": F.lead("scan_date").over(own)})
    return rows.withColumns({"is_new": ~F.coalesce(F.col("seen_before") == F.col("previous"), F.lit(False)), "is_last": ~F.coalesce(F.col("seen_after") == F.col("next"), F.lit(False))})


def direction(delta: Column) -> Column:
    return F.when(delta < 0, "improving").when(delta > 0, "worsening").otherwise("stable")


def scan_deltas(facts: DataFrame) -> DataFrame:
    """(scan_date, total, total_delta, new_count, fixed_count, direction); the first scan is ``unknown``."""
    rows = spells(facts)
    now = rows.groupBy("scan_date").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_new").alias("new_count"))
    gone = rows.filter("is_last and next is not null").groupBy(F.col("next").alias("scan_date")).agg(F.count(F.lit(1)).alias("fixed_count"))
    w = Window.orderBy("scan_date")
    out = now.join(gone, "scan_date", "left").withColumn("fixed_count", F.coalesce("fixed_count", F.lit(0))).withColumn("total_delta", F.col("total") - F.lag("total").over(w))
    return out.withColumn("direction", F.when(F.col("total_delta").isNull(), "unknown").otherwise(direction(F.col("total_delta"))))


def severity_deltas(findings: DataFrame) -> DataFrame:
    """(severity, before, after, delta) of the last two scans."""
    days = findings.select("scan_date").distinct().orderBy(F.col("scan_date").desc()).limit(2)
    n = days.withColumn("n", F.row_number().over(Window.orderBy(F.col("scan_date").desc())))
    per = findings.join(F.broadcast(n), "scan_date").groupBy("severity").agg(F.count_if(F.expr("n = 2")).alias("before"), F.count_if(F.expr("n = 1")).alias("after"))
    return per.withColumn("delta", F.col("after") - F.col("before"))


def time_to_fix(facts: DataFrame) -> DataFrame:
    """(episodes, mttr_days): mean days from a key's appearance to the first scan without it; a return starts anew."""
    rows = spells(facts)
    w = Window.partitionBy("key").orderBy("scan_date")
    named = rows.withColumn("episode", F.sum(F.col("is_new").cast("int")).over(w))
    spans = named.groupBy("key", "episode").agg(F.min("scan_date").alias("begun"), F.max(F.when(F.col("is_last"), F.col("next"))).alias("fixed")).filter("fixed is not null")
    return spans.agg(F.count(F.lit(1)).alias("episodes"), F.round(F.avg(F.datediff("fixed", "begun")), 4).alias("mttr_days"))


def latest(history: DataFrame, by: str = "ts") -> DataFrame:
    return history.agg(F.max_by(F.struct(*history.columns), F.struct(by, *[c for c in history.columns if c != by])).alias("r")).select("r.*")


# Compliance.


def controls(spark) -> DataFrame:
    rows = [(f, c, n) for f, c, cwes in CONTROLS for n in cwes]
    return spark.createDataFrame(rows, "framework string, control string, n int")


def control_hits(findings: DataFrame, dim: DataFrame) -> DataFrame:
    """(framework, control, findings, status) of all controls; ``gap`` without a finding."""
    per = findings.select(F.explode(text.cwe_numbers(F.col("cwe"))).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    rows = dim.join(per, "n", "left").groupBy("framework", "control").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("findings"))
    return rows.withColumn("status", F.when(F.col("findings") > 0, "pass").otherwise("gap"))


def coverage(hits: DataFrame) -> DataFrame:
    """(framework, controls, covered, coverage_pct)."""
    out = hits.groupBy("framework").agg(F.count(F.lit(1)).alias("controls"), F.count_if(F.expr("status = 'pass'")).alias("covered"))
    return out.withColumn("coverage_pct", F.round(100.0 * F.col("covered") / F.col("controls"), 4))


def risk(findings: DataFrame) -> DataFrame:
    """(score, grade) from 0 to 100; suppressed findings cost nothing, none at all give 100."""
    open_ = F.when(~F.col("is_suppressed"), scoring.cost(F.col("severity"), F.col("confidence"))).otherwise(0.0)
    out = findings.agg(F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum(open_), F.lit(0.0))), 4).alias("score"))
    return out.withColumn("grade", scoring.grade(F.col("score")))
