"""Queries through files: what is written to the shared folder is what the readers give back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import versions
from siltstone.operators import baseline, report
from siltstone.plans.catalogue import findings, query
from siltstone.plans.governance import _HELD, _KNOWN, _PRINTED, held, known, printed
from siltstone.schemas import BASELINE
from siltstone.scratch import scratch_dir
from siltstone.sources import files, tables


def _folder(spark, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _documents(rows: DataFrame, folder: str, part: str) -> None:
    """Write ``text``, one row for each part, as a file each."""
    rows.select(part, "text").write.partitionBy(part).text(folder)


@query(
    f"""WITH {_PRINTED}, {_KNOWN}, n AS (SELECT unnest([fingerprint, fingerprint_v1]) AS fingerprint, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2024-02-01' END AS first_seen FROM p)
    SELECT fingerprint, min(first_seen) AS first_seen FROM (SELECT fingerprint, first_seen FROM k UNION ALL SELECT * FROM n) GROUP BY fingerprint"""
)
def baseline_saved(spark, sf_dir):
    """A saved baseline that two writers bring up to date at once, each with part of the findings: the one that comes second starts again."""
    folder, rows = _folder(spark, "baseline"), printed(spark, sf_dir)
    at = lambda day: F.to_timestamp(F.lit(f"{day} 00:00:00"))
    versions.commit(spark, folder, BASELINE, lambda old: known(spark, sf_dir).select("fingerprint", "first_seen"))
    between = [lambda: baseline.update(spark, folder, rows.filter("event_id % 3 = 0"), at("2024-01-15"))]

    def second(old: DataFrame) -> DataFrame:
        if between:
            between.pop()()
        return baseline.updated(old, rows.filter("event_id % 3 <> 0"), at("2024-02-01"))

    versions.commit(spark, folder, BASELINE, second)
    return baseline.latest(spark, folder)


@query(f"WITH {_PRINTED} SELECT fingerprint, min(scan_date)::TIMESTAMP AS first_seen FROM p WHERE severity IN ('critical', 'high', 'medium') GROUP BY fingerprint")
def baseline_documents(spark, sf_dir):
    """A JSON baseline for each severity; that of low has another version and that of info is cut off."""
    keys = printed(spark, sf_dir).groupBy("severity", "fingerprint").agg(F.min("scan_date").cast("timestamp").alias("first_seen"))
    box = F.struct(F.when(F.col("severity") == "low", 1).otherwise(2).alias("version"), F.map_from_entries(F.collect_list(F.struct("fingerprint", F.struct("first_seen")))).alias("fingerprints"))
    texts = keys.groupBy("severity").agg(F.to_json(box).alias("text"))
    folder = _folder(spark, "documents")
    _documents(texts.withColumn("text", F.when(F.col("severity") == "info", F.substring("text", 1, 60)).otherwise(F.col("text"))), folder, "severity")
    return files.load_baseline(spark, folder)[0]


@query(f"WITH {_PRINTED}, {_HELD} SELECT fingerprint, reason, owner, expires_at FROM s")
def suppression_files(spark, sf_dir):
    """JSON lists of suppressions, a file for each reason."""
    folder = _folder(spark, "suppressions")
    _documents(held(spark, sf_dir).groupBy(F.col("reason").alias("part")).agg(F.to_json(F.collect_list(F.struct("fingerprint", "reason", "owner", "expires_at"))).alias("text")), folder, "part")
    return files.load_suppressions(spark, f"{folder}/part=*")


@query("SELECT 'scan-' || scan_date AS scan_id, count(*)::INTEGER AS total_findings, count(*) FILTER (WHERE severity = 'high')::INTEGER AS high FROM f GROUP BY scan_date ORDER BY scan_date DESC LIMIT 10")
def history_files(spark, sf_dir):
    """The ten newest scans of a history appended to three times, the newer scans first and at last once more."""
    folder = _folder(spark, "history")
    entries = report.history_entries(printed(spark, sf_dir))
    for older in (False, True, False):
        report.append_history(entries.filter((F.col("timestamp") < "2024-01-20") == F.lit(older)), folder)
    return files.load_history(spark, folder, 10).select("scan_id", "total_findings", F.coalesce(F.col("severity_counts")["high"], F.lit(0)).alias("high"))


@query("SELECT page_id AS target, 'first' AS session_id FROM pages WHERE page_id % 2 = 0", raw=True)
def plan_saved(spark, sf_dir):
    """A plan replaced by a smaller one, made from it, that keeps its session."""
    folder = _folder(spark, "plan")
    report.save_plan(spark, folder, "target bigint", lambda old: tables.load(spark, sf_dir, "pages").select(F.col("page_id").alias("target")), "first")
    report.save_plan(spark, folder, "target bigint", lambda old: old.filter("target % 2 = 0"), "second")
    return report.load_plan(spark, folder, "target bigint")


@query("SELECT 'scan-' || scan_date AS scan_id, count(*)::INTEGER AS total_findings FROM f WHERE scan_date >= DATE '2024-01-10' GROUP BY scan_date")
def history_since(spark, sf_dir):
    """Scans of the days from one on; the folders of earlier ones are not read."""
    folder = _folder(spark, "history")
    report.append_history(report.history_entries(printed(spark, sf_dir)), folder)
    return files.load_history(spark, folder, since="2024-01-10").select("scan_id", "total_findings")
