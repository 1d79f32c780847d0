"""Validators: rows in, error lists out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import paths
from siltstone.functions.severity import ORDER
from siltstone.operators import normalize
from siltstone.operators.triage import STATUSES

#: Version of the envelope that this engine writes and expects.
ENVELOPE_VERSION = "1.0"
REPO_BUILD = r"^(\./)?(mvnw|gradlew|make|cmake|build\.sh)\b"
PACKAGE_BUILD = r"^(mvn|gradle|npm|yarn|pip|cargo|go)\b"


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))


def llm_findings(rows: DataFrame) -> DataFrame:
    """Adds errors and is_valid to rows with severity, status, file and title."""
    errors = _errors(
        (~F.coalesce(F.col("severity").isin(*ORDER), F.lit(False)), "severity"),
        (F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "triage.status"),
        (F.coalesce("file", F.lit("")) == "", "file"),
        (F.coalesce("title", F.lit("")) == "", "title"),
    )
    return rows.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def import_llm(texts: DataFrame, root: str, text: str = "text") -> DataFrame:
    """As ``from_llm``, with files relative to ``root``; a payload with a finding that is not valid gives no rows at all."""
    f = normalize.llm_body(text)
    valid = lambda x: x["severity"].isin(*ORDER) & (x["triage"]["status"].isNull() | x["triage"]["status"].isin(*STATUSES)) & (x["file"] != "") & (x["title"] != "")
    good = texts.filter(F.forall(f, lambda x: F.coalesce(valid(x), F.lit(False))))
    return normalize.from_llm(good, text).withColumn("file", paths.relative(F.col("file"), root))


def envelopes(texts: DataFrame, text: str = "text", agent: bool = False) -> DataFrame:
    """Adds errors: the version, a list of findings, and for an agent's the mark that its review is complete; a bare list is valid."""
    e = F.from_json(text, schemas.ENVELOPE)
    bare = F.ltrim(F.col(text)).startswith("[")
    checks = [(~bare & ~F.coalesce(e["schema_version"] == ENVELOPE_VERSION, F.lit(False)), "schema_version"), (~bare & e["findings"].isNull() & e["confirmed_findings"].isNull(), "findings")]
    if agent:
        checks.append((bare | ~F.coalesce(e["agent_review_complete"], F.lit(False)), "agent_review_complete"))
    return texts.withColumn("errors", _errors(*checks))


def sarif(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds errors of structure; a text that is no JSON lacks all."""
    log = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schemas.SARIF))
    runs = log["runs"]
    return texts.withColumn(
        "errors",
        _errors(
            (log["$schema"].isNull(), "$schema"),
            (~F.coalesce(log["version"] == "2.1.0", F.lit(False)), "version"),
            (runs.isNull(), "runs"),
            (F.exists(runs, lambda r: r["tool"]["driver"]["name"].isNull()), "tool.driver.name"),
            (F.exists(runs, lambda r: F.exists(r["results"], lambda x: x["message"]["text"].isNull())), "message.text"),
        ),
    )


def build_commands(rows: DataFrame, allow_repo: bool | Column, allow_package: bool | Column = True, command: str = "command") -> DataFrame:
    """Adds is_repo_command and is_allowed; the policy is fixed or of each row."""
    c = F.trim(F.col(command))
    repo = c.rlike(REPO_BUILD)
    return rows.withColumn("is_repo_command", repo).withColumn("is_allowed", (repo & allow_repo) | (~repo & c.rlike(PACKAGE_BUILD) & allow_package))


def rules(rows: DataFrame) -> DataFrame:
    """Adds errors to rules (rule_id, pattern, severity, cwe, language)."""
    return rows.withColumn(
        "errors",
        _errors(
            (F.coalesce("rule_id", F.lit("")) == "", "id"),
            (F.coalesce("pattern", F.lit("")) == "", "pattern"),
            (~F.coalesce(F.col("severity").isin(*ORDER), F.lit(False)), "severity"),
            (~F.coalesce(F.col("cwe").rlike(r"^CWE-\d+$"), F.lit(False)), "cwe"),
        ),
    )


def own_annotations(lines: DataFrame, allowed: DataFrame) -> DataFrame:
    """Lines without annotations of foreign rules; code stays."""
    rule = F.regexp_extract("text", r"(?:ruleid|ok):\s*([\w.-]+)", 1)
    return lines.withColumn("rule_id", rule).join(allowed.select("rule_id", F.lit(True).alias("_own")), "rule_id", "left").filter("rule_id = '' or _own").drop("_own", "rule_id")


def matching_files(labels: DataFrame, allowed: DataFrame) -> DataFrame:
    """Fixture files with an annotation of one of the rules."""
    return labels.join(allowed, "rule_id", "left_semi").select("path").distinct()
