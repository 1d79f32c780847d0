"""Views of the driver's tables as findings, lines, verdicts and scans.

There is no findings table among them, so one is derived from ``events`` by plain
expressions, the same in any SQL engine; ``FINDINGS`` is that SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One finding for each event. ``coarse`` identifies it over scans, which are days.
FINDINGS = """
SELECT event_id, ts, CAST(ts AS DATE) AS scan_date, concat('F-', CAST(event_id AS STRING)) AS id,
  CASE event_id % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'bandit' ELSE 'llm-analyzer' END AS tool,
  event_type AS rule_id,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity,
  CASE event_id % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence,
  CASE user_id % 5 WHEN 0 THEN concat('src/tests/u', CAST(user_id AS STRING), '.py') WHEN 1 THEN concat('vendor/u', CAST(user_id AS STRING), '.py')
    WHEN 2 THEN concat('lib/u', CAST(user_id AS STRING), '.ts') ELSE concat('src/u', CAST(user_id AS STRING), '.py') END AS file,
  CAST({k} AS INT) AS start_line,
  CASE event_type WHEN 'error' THEN 'CWE-89' WHEN 'purchase' THEN 'CWE-78' WHEN 'signup' THEN 'CWE-798' WHEN 'click' THEN 'CWE-328' ELSE 'CWE-22' END AS cwe,
  concat('call(', CAST(user_id % 11 AS STRING), ',  ', event_type, ')') AS snippet,
  CAST(event_id % 4 AS INT) AS n_steps,
  CASE event_id % 10 WHEN 0 THEN 'false-positive' WHEN 1 THEN 'needs-review' WHEN 2 THEN 'confirmed' ELSE 'active' END AS status,
  event_id % 6 = 0 AS is_suppressed,
  event_id % 8 <> 0 AS is_new,
  concat(CAST(user_id AS STRING), ':', event_type) AS coarse
FROM events
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FINDINGS.format(k="get_json_object(props, '$.k')").replace("FROM events", "FROM {events}"), events=load(spark, sf_dir, "events"))


def duck(query: str) -> str:
    """``query`` over f, the same findings in the other engine's SQL."""
    body = FINDINGS.format(k="json_extract_string(props, '$.k')").replace("AS STRING", "AS VARCHAR")
    query = query.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(head):
            return f"{head}f AS ({body}), {query[len(head):]}"
    return f"WITH f AS ({body}) {query}"
