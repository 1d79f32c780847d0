"""The findings and their operators by name in SQL text: a view, and functions of the session's catalogue.

Functions are SQL themselves, so Catalyst sees through them: filters on what they return reach
the scan, and only the columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from siltstone.functions import paths, severity

_RANKS = " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(severity.ORDER))
_COUNTS = ", ".join(f"count_if(severity = '{s}') AS {s}" for s in reversed(severity.ORDER))


def _pattern(value: str) -> str:
    return "r'" + value + "'"


#: Scalar functions: signature, type and body.
SCALARS = {
    "severity_rank(value STRING)": ("INT", f"CASE lower(value) {_RANKS} END"),
    "severity_at_least(value STRING, threshold STRING)": ("BOOLEAN", "severity_rank(value) >= severity_rank(threshold)"),
    "severity_reduced(value STRING)": ("STRING", "coalesce(element_at(array(" + ", ".join(f"'{s}'" for s in severity.ORDER) + "), greatest(severity_rank(value) - 1, 0) + 1), value)"),
    "is_test_path(path STRING)": ("BOOLEAN", f"rlike(path, {_pattern(paths.TEST)})"),
    "is_generated_path(path STRING)": ("BOOLEAN", f"rlike(path, {_pattern(paths.GENERATED)})"),
}


def register(findings: DataFrame, view: str = "findings") -> list[str]:
    """Name ``findings`` and the functions over it in the session; the names of the functions.

    Besides the SCALARS: ``open_findings(threshold)`` gives the new, unsuppressed findings at a severity or
    above with the columns of the view, ``gate(threshold, review)`` the row of ``triage.gate``, and
    ``per_file(threshold)`` (file, n, worst) of the open ones. Findings need is_new, is_suppressed, severity, status and file. Names are of this
    session and may be registered again.
    """
    spark = findings.sparkSession
    findings.createOrReplaceTempView(view)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.schema)
    tables = {
        "open_findings(threshold STRING DEFAULT 'high')": (columns, f"SELECT * FROM {view} WHERE is_new AND NOT is_suppressed AND severity_at_least(severity, threshold)"),
        "gate(threshold STRING DEFAULT 'high', review BOOLEAN DEFAULT false)": (
            "blocking_count BIGINT, review_only_count BIGINT, " + ", ".join(f"{s} BIGINT" for s in reversed(severity.ORDER)) + ", passed BOOLEAN",
            # Parameters may stand beside columns, not within aggregates.
            f"""SELECT *, blocking_count = 0 FROM (SELECT count_if(met AND (asked OR status <> 'needs-review')), count_if(met AND status = 'needs-review'), {_COUNTS}
              FROM (SELECT severity, status, is_new AND NOT is_suppressed AND severity_at_least(severity, threshold) AS met, review AS asked FROM {view})) AS t(blocking_count, review_only_count, {", ".join(reversed(severity.ORDER))})""",
        ),
        "per_file(threshold STRING DEFAULT 'info')": ("file STRING, n BIGINT, worst STRING", "SELECT file, count(*), max_by(severity, severity_rank(severity)) FROM open_findings(threshold) GROUP BY file"),
    }
    for signature, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    for signature, (kind, body) in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE ({kind}) RETURN {body}")
    return [s.split("(")[0] for s in (*SCALARS, *tables)]
