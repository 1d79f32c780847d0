"""Scanner reports to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import identity, severity

TOOLS = ("semgrep", "gitleaks", "checkov", "bandit", "gosec", "codeql")
#: PHPStan identifiers that speak of security; the first stays high even where the finding can be ignored.
PHP_SECURITY, PHP_ALWAYS = r"^security\.|unsafe|eval|shell|xss|path|sql", r"^security\."


def results(logs: DataFrame) -> DataFrame:
    """One row a result, with its rule by position and else by id, where the rule list has it."""
    runs = logs.select(*[c for c in logs.columns if c != "log"], F.explode("log.runs").alias("run"))
    each = runs.select("*", F.explode("run.results").alias("r"))
    rules = F.col("run.tool.driver.rules")
    by_id = F.get(F.filter(rules, lambda x: x["id"] == F.col("r.ruleId")), 0)
    return each.withColumn("rule", F.coalesce(F.get(rules, F.col("r.ruleIndex")), by_id)).withColumn("driver", F.lower("run.tool.driver.name"))


def _severity(tool: Column) -> tuple[Column, Column]:
    """(severity, confidence) by tool; a tool without rules of its own follows the first."""
    props = F.col("rule.properties")
    level = F.coalesce(severity.from_level(F.col("r.level")), severity.from_level(F.col("rule.defaultConfiguration.level")), F.lit("medium"))
    stated = F.lower(props["issue_severity"])
    scored = severity.from_score(props["security-severity"])
    sev = F.when(tool == "gitleaks", F.lit("high")).when(tool.isin("bandit", "gosec"), F.coalesce(stated, level)).when(tool == "codeql", F.coalesce(scored, level)).otherwise(level)
    said = F.lower(F.coalesce(props["issue_confidence"], props["precision"]))
    conf = F.when((tool == "codeql") & scored.isin("critical", "high"), F.lit("high")).otherwise(F.coalesce(F.when(said.isin("high", "medium", "low"), said), F.lit("medium")))
    return sev, conf


def from_sarif(logs: DataFrame, tool: Column | str | None = None) -> DataFrame:
    """Findings of parsed logs; ``tool`` is a name, a column, or by default the driver's own name."""
    rows = results(logs)
    name = F.col("driver") if tool is None else F.lit(tool) if isinstance(tool, str) else tool
    place = F.get(F.col("r.locations"), 0)["physicalLocation"]
    steps = F.flatten(F.flatten(F.transform("r.codeFlows", lambda c: F.transform(c["threadFlows"], lambda t: t["locations"]))))
    flow = F.transform(
        steps,
        lambda s: F.struct(
            s["location"]["physicalLocation"]["artifactLocation"]["uri"].alias("file"),
            s["location"]["physicalLocation"]["region"]["startLine"].alias("line"),
            s["location"]["message"]["text"].alias("message"),
            F.lit(None).cast("string").alias("label"),
        ),
    )
    sev, conf = _severity(name)
    tags = F.coalesce(F.col("rule.properties.tags"), F.array().cast("array<string>"))
    cwe = F.filter(tags, lambda t: t.rlike(r"(?i)cwe-?\d+"))
    out = rows.select(
        *[c for c in logs.columns if c not in ("log", "text")],
        name.alias("tool"),
        F.coalesce("r.ruleId", "rule.id").alias("rule_id"),
        F.coalesce("rule.shortDescription.text", "r.ruleId").alias("title"),
        F.col("r.message.text").alias("message"),
        sev.alias("severity"),
        conf.alias("confidence"),
        place["artifactLocation"]["uri"].alias("file"),
        place["region"]["startLine"].alias("start_line"),
        F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).alias("end_line"),
        F.transform(cwe, lambda t: F.concat(F.lit("CWE-"), F.regexp_extract(t, r"(\d+)", 1))).alias("cwe"),
        F.filter(tags, lambda t: t.rlike("(?i)owasp")).alias("owasp"),
        place["region"]["snippet"]["text"].alias("snippet"),
        F.coalesce(flow, F.array().cast(f"array<{schemas.STEP}>")).alias("dataflow"),
        F.col("rule.help.text").alias("recommendation"),
    )
    return with_identity(out)


def with_identity(rows: DataFrame) -> DataFrame:
    """Adds evidence, snippet_hash and both fingerprints to rows with file, rule, lines, cwe, snippet and dataflow."""
    evidence = F.struct(F.coalesce("snippet", F.lit("")).alias("source"), F.lit("").alias("sink"), F.col("dataflow"))
    return (
        rows.withColumn("evidence", evidence)
        .withColumn("snippet_hash", F.sha2(identity.normalized(F.col("snippet")), 256))
        .withColumn("fingerprint", identity.fingerprint(F.col("file"), F.col("rule_id"), F.col("cwe"), F.col("snippet"), F.col("start_line"), F.col("end_line")))
        .withColumn("fingerprint_v1", identity.fingerprint_v1(F.col("file"), F.col("start_line"), F.col("rule_id")))
        .withColumn("tools", F.array("tool"))
        .withColumn("rule_ids", F.array("rule_id"))
        .drop("snippet", "dataflow")
    )


def dispatched(logs: DataFrame, tool: str = "tool") -> DataFrame:
    """By the tool named in a column; unknown tools as the first of TOOLS."""
    known = F.when(F.col(tool).isin(*TOOLS), F.col(tool)).otherwise(TOOLS[0])
    return from_sarif(logs.withColumn("_tool", known).drop(tool), F.col("_tool")).drop("_tool")


def from_eslint(texts: DataFrame, text: str = "text") -> DataFrame:
    files = texts.select(*[c for c in texts.columns if c != text], F.explode(F.from_json(text, schemas.ESLINT)).alias("f"))
    each = files.select(*[c for c in texts.columns if c != text], F.col("f.filePath").alias("file"), F.explode("f.messages").alias("m"))
    return each.select("*", F.lit("eslint").alias("tool"), F.col("m.ruleId").alias("rule_id"), F.col("m.message").alias("message"), severity.from_eslint(F.col("m.severity")).alias("severity"), F.col("m.line").alias("start_line")).drop("m")


def php_severity(identifier: Column, ignorable: Column) -> Column:
    security = identifier.rlike(PHP_SECURITY)
    return F.when(identifier.rlike(PHP_ALWAYS), "high").when(F.coalesce(ignorable, F.lit(False)), "low").when(security, "high").otherwise("medium")


def from_phpstan(texts: DataFrame, text: str = "text") -> DataFrame:
    """Reports whose ``files`` is not an object give no rows."""
    files = texts.select(*[c for c in texts.columns if c != text], F.explode(F.from_json(text, schemas.PHPSTAN)["files"]).alias("file", "v"))
    each = files.select("*", F.explode("v.messages").alias("m")).drop("v")
    return each.select("*", F.lit("phpstan").alias("tool"), F.col("m.identifier").alias("rule_id"), F.col("m.message").alias("message"), php_severity(F.col("m.identifier"), F.col("m.ignorable")).alias("severity"), F.col("m.line").alias("start_line")).drop("m")


def importable(envelope: Column) -> Column:
    """All findings of an envelope: its own, and the confirmed ones with that status."""
    confirmed = F.transform(
        envelope["confirmed_findings"],
        lambda c: c["finding"].withField("triage", F.coalesce(c["finding"]["triage"], F.lit(None).cast(schemas.TRIAGE))).withField("triage", F.struct(F.lit("confirmed").alias("status"), c["finding"]["triage"]["rationale"].alias("rationale"), c["finding"]["triage"]["confidence"].alias("confidence"), c["finding"]["triage"]["validated_at"].alias("validated_at"))),
    )
    empty = F.array().cast(schemas.LLM_LIST)
    return F.concat(F.coalesce(envelope["findings"], empty), F.coalesce(confirmed, empty))


def llm_body(text: str) -> Column:
    """The findings of an envelope or a bare list."""
    return F.when(F.ltrim(F.col(text)).startswith("["), F.from_json(text, schemas.LLM_LIST)).otherwise(importable(F.from_json(text, schemas.ENVELOPE)))


def from_llm(texts: DataFrame, text: str = "text") -> DataFrame:
    """Envelopes or bare lists; triage, enrichment and notes pass through."""
    kept = [c for c in texts.columns if c != text]
    return texts.select(*kept, F.explode(llm_body(text)).alias("f")).select(*kept, "f.*").withColumn("tool", F.lit("llm-analyzer"))


def origin(tool: Column) -> Column:
    return F.when(tool == "llm-analyzer", "llm-discovery").otherwise("rule-engine")


def evidence_strength(steps: Column, source: Column, sink: Column) -> Column:
    both = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(sink, F.lit("")) != "")
    return F.when(steps > 0, "dataflow-trace").when(both, "source-sink").otherwise("pattern-match")


def triage_status(status: Column, suppressed: Column) -> Column:
    """An explicit status wins."""
    return F.coalesce(status, F.when(suppressed, "false-positive").otherwise("active"))


def tool_outcomes(rows: DataFrame) -> DataFrame:
    """(tool, status, reason, fix_command) of tools that did not succeed."""
    missing = F.lower(F.coalesce("error_message", F.lit(""))).rlike("not installed|not found|skip")
    return rows.filter("not success").select("tool", F.when(missing, "skipped").otherwise("failed").alias("status"), F.col("error_message").alias("reason"), F.when(missing, F.concat(F.lit("pip install "), "tool")).alias("fix_command"))


def semgrep_results(texts: DataFrame, text: str = "text") -> DataFrame:
    """(path, check_id, cwe) of raw result lists; ``cwe`` is a string or a list there, an array here."""
    each = texts.select(F.explode(F.from_json(text, schemas.SEMGREP)["results"]).alias("r"))
    raw = F.col("r.extra.metadata.cwe")
    return each.select("r.path", "r.check_id", F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array_compact(F.array(raw))).alias("cwe"))
