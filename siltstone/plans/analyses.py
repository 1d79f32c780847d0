"""Queries: rules and analyses over lines of documents and over source files made from rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import paths
from siltstone.functions import text as words
from siltstone.operators import detect, report, validate
from siltstone.plans import samples
from siltstone.plans.catalogue import as_sql, findings, query
from siltstone.scratch import settle
from siltstone.sources import files, tables

RULES = (
    ("secret.token", r'token = "[0-9a-f]{40}"', "critical", "CWE-798"),
    ("pii.email", r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[a-z]+", "medium", "CWE-359"),
    ("net.address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "low", "CWE-200"),
    ("legal.license", r"(Licensed|License)", "info", "CWE-0"),
)
_LINES = "l AS (SELECT doc_id::VARCHAR AS path, doc_id, i::INT AS line, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
_RULES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in RULES) + ") t(rule_id, pattern, severity, cwe))"


def documents(spark, sf_dir):
    """Documents as files."""
    return tables.load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")


def rules(spark):
    return spark.createDataFrame(list(RULES), "rule_id string, pattern string, severity string, cwe string")


_HITS = f"WITH {_LINES}, {_RULES}, h AS (SELECT path, line, rule_id, severity, cwe FROM l JOIN r ON regexp_matches(text, pattern))"


@query(_HITS + " SELECT * FROM h", raw=True)
def rule_hits_by_line(spark, sf_dir):
    return detect.apply_rules(files.lines(documents(spark, sf_dir)), rules(spark))


# A label on the line of each e-mail of even documents, one line above it for odd ones, and lines that are fine where a license is.
_LABELS = "b AS (SELECT path, line - (path::BIGINT % 4)::INT AS line, rule_id, 'ruleid' AS polarity FROM h WHERE rule_id = 'pii.email' UNION ALL SELECT path, line, rule_id, 'ok' FROM h WHERE rule_id = 'legal.license' AND path::BIGINT % 2 = 0)"


@query(
    _HITS
    + f""", {_LABELS}, m AS (SELECT b.*, EXISTS (SELECT 1 FROM h WHERE h.path = b.path AND h.rule_id = b.rule_id AND h.line BETWEEN b.line AND b.line + 2) AS met FROM b WHERE polarity = 'ruleid'),
    n AS (SELECT path, count(*) AS n_lines FROM l GROUP BY path), q AS (SELECT path, count(*) AS labels, count(*) FILTER (WHERE NOT met) AS missed FROM m GROUP BY path), x AS (SELECT path, count(*) AS fp FROM b WHERE polarity = 'ok' GROUP BY path)
    SELECT path, n_lines, coalesce(labels, 0) AS labels, coalesce(missed, 0) AS missed, coalesce(fp, 0) AS false_positives, round(1 - coalesce(fp, 0) / greatest(n_lines, 1), 6)::DOUBLE AS precision, round(1 - coalesce(missed, 0) / greatest(coalesce(labels, 0), 1), 6)::DOUBLE AS recall FROM n LEFT JOIN q USING (path) LEFT JOIN x USING (path)""",
    raw=True,
)
def corpus_scores(spark, sf_dir):
    # Read by findings, labels and lines alike, so each document is matched once.
    hits = settle(rule_hits_by_line(spark, sf_dir).select("path", "line", "rule_id"), "hits", few=True)
    shift = (F.col("path").cast("bigint") % 4).cast("int")
    want = hits.filter("rule_id = 'pii.email'").select("path", (F.col("line") - shift).alias("line"), "rule_id", F.lit("ruleid").alias("polarity"))
    fine = hits.filter("rule_id = 'legal.license' and cast(path as bigint) % 2 = 0").select("path", "line", "rule_id", F.lit("ok").alias("polarity"))
    sizes = documents(spark, sf_dir).filter("text is not null").groupBy("path").agg(F.sum(F.size(F.split("text", "\n"))).alias("n_lines"))
    return detect.corpus_scores(hits, want.union(fine), sizes)


@query(
    _HITS
    + f""", {_LABELS}, m AS (SELECT b.*, EXISTS (SELECT 1 FROM h WHERE h.path = b.path AND h.rule_id = b.rule_id AND h.line BETWEEN b.line AND b.line + 2) AS met FROM b WHERE polarity = 'ruleid'),
    s AS (SELECT (SELECT count(DISTINCT path) FROM l) AS files, (SELECT count(*) FROM l) AS n_lines, (SELECT count(*) FROM m) AS labels, (SELECT count(*) FROM m WHERE NOT met) AS missed, (SELECT count(*) FROM b WHERE polarity = 'ok') AS false_positives)
    SELECT *, round(1 - false_positives / greatest(n_lines, 1), 6)::DOUBLE AS precision, round(1 - missed / greatest(labels, 1), 6)::DOUBLE AS recall FROM s""",
    raw=True,
)
def corpus_report(spark, sf_dir):
    return detect.corpus_report(corpus_scores(spark, sf_dir))


@query(_HITS + " SELECT rule_id, count(*) AS hits, count(DISTINCT path) AS n_files FROM h GROUP BY rule_id", raw=True)
def corpus_overall(spark, sf_dir):
    return rule_hits_by_line(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("n_files"))


_RE2 = {name: pattern.replace(r"[\s\S]*?", "(?s:.)*?") for name, pattern in words.SECRETS}
_REDACT = "text"
for _name, _pattern in _RE2.items():
    _REDACT = f"regexp_replace({_REDACT}, '{_pattern}', '[REDACTED-{_name}]', 'g')"


@query(f"SELECT doc_id, md5({_REDACT}) AS redacted, {_REDACT} <> text AS changed FROM documents", raw=True)
def redact_tokens(spark, sf_dir):
    done = words.redacted(F.col("text"))
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.md5(done).alias("redacted"), (done != F.col("text")).alias("changed"))


_REDACTED = "value"
for _name, _pattern in _RE2.items():
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '[REDACTED-{_name}]', 'g')"


@query(f"SELECT event_id, {_REDACTED} AS source, 'x ' || {_REDACTED} AS step FROM {samples.duck(samples.SECRET)}")
def redact_nested(spark, sf_dir):
    rows = samples.made(findings(spark, sf_dir), "event_id", secret=samples.SECRET)
    null = F.lit(None).cast("string")
    step = F.struct(null.alias("file"), F.lit(1).alias("line"), F.concat(F.lit("x "), "secret").alias("message"), null.alias("label"))
    evidence = F.struct(F.col("secret").alias("source"), F.lit("").alias("sink"), F.array(step).alias("dataflow"))
    return rows.select("event_id", words.redacted_evidence(evidence).alias("e")).select("event_id", "e.source", F.col("e.dataflow")[0]["message"].alias("step"))


@query(f"SELECT event_id, {_REDACTED} AS message, {_REDACTED} || chr(10) || 'end' AS snippet FROM {samples.duck(samples.SECRET)}")
def redact_sarif(spark, sf_dir):
    """Logs with secrets in two strings, redacted as text and read again."""
    rows = samples.made(findings(spark, sf_dir), "event_id", secret=samples.SECRET)
    said = lambda value: F.struct(value.alias("text"))
    place = F.struct(F.struct(F.struct(said(F.concat("secret", F.lit("\nend"))).alias("snippet")).alias("region")).alias("physicalLocation"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.array(F.struct(said(F.col("secret")).alias("message"), F.array(place).alias("locations"))).alias("results"))).alias("runs"))
    result = F.from_json(words.redacted_json(F.to_json(log)), schemas.SARIF)["runs"][0]["results"][0]
    return rows.select("event_id", result.alias("r")).select("event_id", F.col("r.message.text").alias("message"), F.col("r.locations")[0]["physicalLocation"]["region"]["snippet"]["text"].alias("snippet"))


def code(spark, sf_dir):
    """(event_id, path, text) of a file for each finding."""
    return samples.made(findings(spark, sf_dir), "event_id", path=samples.PATH, text=samples.TEXT)


_CODE = f"WITH {samples.FILES}, {samples.FILE_LINES}"
_HAS = lambda pattern, of="text": f"regexp_matches({of}, {as_sql(pattern)})"
_ALL = lambda pattern, of="text": f"list_distinct(regexp_extract_all({of}, {as_sql(pattern)}, 1))"
_WORD = "list_distinct(regexp_extract_all(text, '(\\w+)', 1))"


def _flows(language: str, ending: str) -> str:
    sinks = " UNION ALL ".join(f"SELECT path, line AS sink_line, text, 'taint.{name}' AS rule_id, '{cwe}' AS cwe FROM cl WHERE {_HAS(pattern)}" for name, (pattern, cwe) in words.SINKS.items())
    return (
        f"{_CODE}, s AS (SELECT path, line AS source_line, unnest(regexp_extract_all(text, {as_sql(words.SOURCES[language])}, 1)) AS variable FROM cl WHERE path LIKE '%.{ending}'), k AS ({sinks}),"
        f" w AS (SELECT path, sink_line, rule_id, cwe, unnest({_WORD}) AS variable FROM k), z AS (SELECT path, line AS at, unnest({_WORD}) AS variable FROM cl WHERE {_HAS(words.SANITIZERS)}),"
        " p AS (SELECT s.path, rule_id, cwe, s.variable, source_line, sink_line FROM s JOIN w ON s.path = w.path AND s.variable = w.variable AND source_line < sink_line)"
        " SELECT p.*, source_line || ' source: ' || variable || ', ' || sink_line || ' sink: ' || variable AS dataflow FROM p WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.path = p.path AND z.variable = p.variable AND z.at > p.source_line AND z.at <= p.sink_line)"
    )


def shown_steps(flows):
    """Dataflow as text, a step after the other."""
    return flows.withColumn("dataflow", F.array_join(F.transform("dataflow", lambda s: F.concat_ws(" ", s["line"], s["message"])), ", "))


@query(_flows("python", "py"))
def taint_python(spark, sf_dir):
    return shown_steps(detect.taint(code(spark, sf_dir).filter("path like '%.py'").select("path", "text"), "python"))


@query(_flows("typescript", "ts"))
def taint_typescript(spark, sf_dir):
    return shown_steps(detect.taint(code(spark, sf_dir).filter("path like '%.ts'").select("path", "text"), "typescript"))


# Flows in the lines of all documents: a word that opens a line and stands in a later one, none past a sanitizer; of each sink the nearest source.
@query(
    f"""WITH {_LINES}, s AS (SELECT path, line AS source_line, regexp_extract(text, '^(\\w+)', 1) AS variable FROM l WHERE regexp_matches(text, '^[A-Za-z]+(\\W|$)')),
    k AS (SELECT path, line AS sink_line, unnest({_WORD}) AS variable FROM l), z AS (SELECT path, line AS at, unnest({_WORD}) AS variable FROM l WHERE {_HAS(words.SANITIZERS)}),
    n AS (SELECT s.path, s.variable, max(source_line) AS source_line, sink_line FROM s JOIN k ON s.path = k.path AND s.variable = k.variable AND source_line < sink_line GROUP BY ALL)
    SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.path = n.path AND z.variable = n.variable AND z.at > n.source_line AND z.at <= n.sink_line)""",
    raw=True,
)
def taint_lines(spark, sf_dir):
    return detect.word_flows(documents(spark, sf_dir))


_FUNCTIONS = f"fn AS (SELECT unnest({_ALL(detect.FUNCTION)}) AS name, path, {_HAS('service', 'path')} AND {_HAS(detect.DATABASE)} AND NOT {_HAS(detect.AUTHZ)} AS risky FROM c)"
_ROUTES = f"ro AS (SELECT event_id, path, text, '/' || regexp_extract(path, 'app/(.*)/route[.]ts', 1) AS url, list_sort({_ALL(detect.HTTP)}) AS methods, {_HAS(detect.AUTH)} AS has_auth, {_HAS(detect.AUTHZ)} AS has_authz, {_HAS(detect.PARAMS)} AS has_params FROM c WHERE path LIKE '%/route.ts')"


@query(f"{_CODE}, {_FUNCTIONS}, {_ROUTES} SELECT path, name, 'CWE-862' AS cwe FROM (SELECT path, unnest({_ALL(detect.CALLS)}) AS name FROM ro WHERE NOT has_authz) WHERE name IN (SELECT name FROM fn WHERE risky)")
def missing_authz(spark, sf_dir):
    rows = code(spark, sf_dir).select("path", "text")
    return detect.missing_authorization(detect.routes(rows), detect.functions(rows))


@query(f"{_CODE}, {_ROUTES} SELECT path, url, methods, has_auth, has_authz, has_params FROM ro")
def route_records(spark, sf_dir):
    return detect.routes(code(spark, sf_dir).select("path", "text")).drop("calls")


_PREFIXES = ("/area1/:path*", "/area2", "", "/area3/*")


@query(f"{_CODE}, {_ROUTES} SELECT path, url, starts_with(url, '/area1') OR starts_with(url, '/area2') OR starts_with(url, '/area3') AS is_protected FROM ro")
def route_prefix_theta(spark, sf_dir):
    prefixes = spark.createDataFrame([(p,) for p in _PREFIXES], "prefix string")
    return detect.protected(detect.routes(code(spark, sf_dir).select("path", "text")), prefixes).select("path", "url", "is_protected")


@query("SELECT page_id, url, starts_with(url, 'https://site') OR starts_with(url, 'http://') AS is_protected FROM pages", raw=True)
def url_prefix_theta(spark, sf_dir):
    prefixes = spark.createDataFrame([("https://site:path*",), ("http:/*",), ("",)], "prefix string").select(F.regexp_replace("prefix", r":path\*", "").alias("prefix")).withColumn("prefix", F.when(F.col("prefix") == "http:/*", "http://").otherwise(F.col("prefix")))
    return detect.protected(tables.load(spark, sf_dir, "pages").select("page_id", "url"), prefixes)


@query(f"{_CODE}, {_ROUTES}, g AS (SELECT *, has_auth OR starts_with(url, '/area1') AS safe FROM ro) SELECT count(*) AS total_routes, count(*) FILTER (WHERE safe) AS protected_routes, count(*) FILTER (WHERE NOT safe) AS unprotected_routes, count(*) FILTER (WHERE safe AND has_params AND NOT has_authz) AS idor_candidates FROM g")
def auth_coverage(spark, sf_dir):
    prefixes = spark.createDataFrame([("/area1/:path*",)], "prefix string")
    return detect.auth_coverage(detect.protected(detect.routes(code(spark, sf_dir).select("path", "text")), prefixes))


@query(
    f"""{_CODE}, m AS (SELECT path, unnest(regexp_extract_all(text, '(findFirst\\(\\{{(?s:.)*?\\}}\\s*\\}}\\s*\\))', 1)) AS call FROM c)
    SELECT DISTINCT path, 'rbac.unscoped-admin-check' AS rule_id, 'CWE-863' AS cwe FROM m WHERE regexp_matches(call, 'role\\s*:') AND contains(lower(call), 'admin') AND NOT regexp_matches(call, 'teamId|orgId|projectId|workspaceId')
    UNION ALL SELECT path, 'rbac.unscoped-list-endpoint', 'CWE-862' FROM c WHERE regexp_matches(text, 'findMany\\(\\s*(\\{{\\s*\\}})?\\s*\\)')"""
)
def rbac_findings(spark, sf_dir):
    return detect.rbac(code(spark, sf_dir).select("path", "text"))


_ENTRIES = f"en AS (SELECT event_id, path, line FROM cl WHERE {_HAS(detect.ENTRY)})"


@query(f"{_CODE}, {_ENTRIES} SELECT path, line FROM en")
def entry_points(spark, sf_dir):
    return detect.entry_points(files.lines(code(spark, sf_dir).select("path", "text")))


@query(f"{_CODE} SELECT path FROM c WHERE {_HAS(detect.SECURITY, 'path')} OR {_HAS(detect.SECURITY_TEXT)}")
def security_files(spark, sf_dir):
    return detect.security_files(code(spark, sf_dir).select("path", "text"))


# A finding on some line of each file, also far below its entry points.
@query(
    f"""{_CODE}, {_ENTRIES}, a AS (SELECT c.event_id, c.event_id % 40 + 1 AS here, max(line) FILTER (WHERE line <= c.event_id % 40 + 1) AS last, count(line) AS n FROM c LEFT JOIN en USING (path) GROUP BY c.event_id)
    SELECT event_id, CASE WHEN here - last <= 10 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS reach_confidence, CASE WHEN here - last <= 10 THEN 'near_entry_point' WHEN n > 0 THEN 'far_from_entry_point' ELSE 'no_entry_points_detected' END AS reason FROM a"""
)
def reachability(spark, sf_dir):
    rows = code(spark, sf_dir)
    entries = detect.entry_points(files.lines(rows.select("path", "text")))
    return detect.reachability(rows.select("event_id", F.col("path").alias("file"), (F.col("event_id") % 40 + 1).cast("int").alias("start_line")), entries).select("event_id", "reach_confidence", "reason")


@query(
    f"""{_CODE}, m AS (SELECT [n FOR n IN [CASE WHEN bool_or(contains(text, 'next/server')) THEN 'nextjs' END, CASE WHEN bool_or(contains(text, 'from flask')) THEN 'flask' END, CASE WHEN bool_or(regexp_matches(text, 'require\\(.express.\\)')) THEN 'express' END, CASE WHEN bool_or(contains(text, 'org.springframework')) THEN 'spring' END] IF n IS NOT NULL] AS frameworks,
    bool_or(regexp_matches(text, 'argparse|click\\.command|int main\\(')) AS cli, count(*) FILTER (WHERE path LIKE '%.py') AS python_files, count(*) FILTER (WHERE path LIKE '%.ts') AS typescript_files FROM c)
    SELECT CASE WHEN len(frameworks) > 0 THEN 'web-app' WHEN cli THEN 'cli-tool' ELSE 'library' END AS archetype, frameworks, python_files, typescript_files FROM m"""
)
def project_profile(spark, sf_dir):
    out = detect.project(code(spark, sf_dir).select("path", "text"))
    n = lambda name: F.filter("languages", lambda x: x["language"] == name)[0]["files"].alias(f"{name}_files")
    return out.select("archetype", "frameworks", n("python"), n("typescript"))


@query(f"WITH {_LINES} SELECT doc_id, md5(string_agg(line || ':' || text, chr(10) ORDER BY line)) AS shown FROM l WHERE line BETWEEN 1 AND 5 GROUP BY doc_id", raw=True)
def context_window(spark, sf_dir):
    shown = F.transform(words.context(F.col("text"), F.lit(2)), lambda x: F.concat_ws(":", x["line"], x["text"]))
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(shown, "\n")).alias("shown"))


_FIX = "CASE " + " ".join(f"WHEN contains(lower(value), '{word}') THEN {as_sql(fix)}" for word, fix in report.FIXES) + f" ELSE {as_sql(report.GENERIC)} END"


@query(f"SELECT event_id, {_FIX} AS fix, len(string_split({_FIX}, '; '))::INT AS n_steps FROM {samples.duck(samples.TITLE)}")
def fix_template(spark, sf_dir):
    fix = report.fix_template(F.col("title"))
    return samples.made(findings(spark, sf_dir), "event_id", title=samples.TITLE).select("event_id", fix.alias("fix"), F.size(report.steps(fix)).alias("n_steps"))


@query("SELECT event_id, ['NORMAL for a command line tool', 'possible RCE', 'depends on the caller', 'review in context'][event_id % 4 + 1] AS said FROM f")
def archetype_context(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("cli-tool", "web-app", "library", "other")])
    return findings(spark, sf_dir).select("event_id", report.archetype_context(F.get(kinds, (F.col("event_id") % 4).cast("int")), F.lit("exec")).alias("said"))


@query(f"SELECT event_id, regexp_replace(regexp_replace(value, '^/repo/', ''), '^([.]{{0,2}}/)+', '') AS path FROM {samples.duck(samples.ODD_PATH)}")
def path_sanitize(spark, sf_dir):
    return samples.made(findings(spark, sf_dir), "event_id", odd=samples.ODD_PATH).select("event_id", paths.relative(F.col("odd"), "/repo").alias("path"))


@query(
    f"""SELECT event_id, regexp_matches(value, 'function\\s+middleware|export\\s+default') AS detected, contains(value, 'getToken') AS has_auth_check,
    [replace(replace(q, '"', ''), chr(39), '') FOR q IN regexp_extract_all(regexp_extract(value, 'matcher\\s*:\\s*(.*)$', 1), '["\\x27][^"\\x27]*["\\x27]')] AS prefixes FROM {samples.duck(samples.GUARD)}"""
)
def middleware_parse(spark, sf_dir):
    rows = samples.made(findings(spark, sf_dir), "event_id", source=samples.GUARD)
    return rows.select("event_id", words.middleware(F.col("source")).alias("m")).select("event_id", "m.*")


@query(
    f"""{_CODE}, m AS (SELECT event_id, line, n, regexp_extract(text, {as_sql(detect.HTTP)}, 1) AS method, {_HAS(words.IMPORT)} AS imported FROM cl),
    r AS (SELECT event_id, line, method || ':' || line || '-' || coalesce(lead(line) OVER (PARTITION BY event_id ORDER BY line) - 1, n) AS region FROM m WHERE method <> ''),
    i AS (SELECT event_id, count(*) FILTER (WHERE imported)::INT AS imports FROM m GROUP BY event_id)
    SELECT event_id, coalesce(handlers, '') AS handlers, imports FROM i LEFT JOIN (SELECT event_id, string_agg(region, ',' ORDER BY line) AS handlers FROM r GROUP BY event_id) USING (event_id)"""
)
def handler_regions(spark, sf_dir):
    shown = F.transform(words.handlers(F.col("text")), lambda h: F.format_string("%s:%d-%d", h["method"], h["start_line"], h["end_line"]))
    return code(spark, sf_dir).select("event_id", F.array_join(shown, ",").alias("handlers"), F.size(words.imports(F.col("text"))).alias("imports"))


@query("SELECT source AS language, count(*) AS total_rules, count(*) FILTER (WHERE doc_id % 3 = 0) AS covered_rules FROM documents GROUP BY ROLLUP (source)", raw=True)
def rule_coverage(spark, sf_dir):
    """A rule for each document, its source standing for the language; every third has an annotation."""
    docs = tables.load(spark, sf_dir, "documents").select(F.concat(F.lit("rule-"), F.col("doc_id").cast("string")).alias("rule_id"), F.col("source").alias("language"), "doc_id")
    fixtures = docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("t"), "rule_id").alias("path"), F.concat(F.lit("x = 1\n# ruleid: "), "rule_id", F.lit("\nbad()\n")).alias("text"))
    return detect.rule_coverage(docs.select("rule_id", "language"), files.annotations(fixtures))


@query("SELECT 'rule-' || doc_id AS rule_id FROM documents WHERE doc_id % 5 = 0 AND doc_id % 2 <> 0", raw=True)
def undefined_rule_ids(spark, sf_dir):
    """Ids annotated in fixtures that no rule file defines."""
    docs = tables.load(spark, sf_dir, "documents").select(F.concat(F.lit("rule-"), F.col("doc_id").cast("string")).alias("rule_id"), "doc_id")
    fixtures = docs.filter("doc_id % 5 = 0").select(F.lit("t.py").alias("path"), F.concat(F.lit("# ok: "), "rule_id", F.lit("\nfine()")).alias("text"))
    defined = docs.filter("doc_id % 2 = 0").select(F.lit("r.yml").alias("path"), F.concat(F.lit("rules:\n  - id: "), "rule_id", F.lit("\n    message: m\n")).alias("text"))
    return files.annotations(fixtures).select("rule_id").join(files.rule_ids(defined), "rule_id", "left_anti").distinct()


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS kept FROM documents", raw=True)
def annotation_filter(spark, sf_dir):
    """Foreign annotations fall out of fixtures, code stays."""
    docs = tables.load(spark, sf_dir, "documents")
    fixture = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("# ruleid: rule-"), (F.col("doc_id") % 2).cast("string"), F.lit("\nbad()\nend")).alias("text"))
    allowed = spark.createDataFrame([("rule-0",)], "rule_id string")
    kept = validate.own_annotations(files.lines(fixture), allowed)
    return kept.groupBy(F.col("path").cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 4 = 1", raw=True)
def matching_fixtures(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents")
    fixture = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("// ruleid: rule-"), (F.col("doc_id") % 4).cast("string"), F.lit("\nbad()")).alias("text"))
    return validate.matching_files(files.annotations(fixture), spark.createDataFrame([("rule-1",)], "rule_id string"))


@query(f"SELECT event_id, regexp_matches(value, '^([.]/|make|cmake)') AS is_repo_command, regexp_matches(value, '^(npm|go) ') AS is_allowed FROM {samples.duck(samples.COMMAND)}")
def build_command_policy(spark, sf_dir):
    rows = samples.made(findings(spark, sf_dir), "event_id", command=samples.COMMAND)
    return validate.build_commands(rows, allow_repo=False).drop("command")


@query("SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 'pattern' END, CASE WHEN event_id % 3 = 0 THEN 'cwe' END], lambda x: x IS NOT NULL) AS errors FROM f")
def rule_validation(spark, sf_dir):
    rows = findings(spark, sf_dir).select("event_id", F.lit("r").alias("rule_id"), F.when(F.col("event_id") % 2 == 0, "").otherwise("x+").alias("pattern"), "severity", F.when(F.col("event_id") % 3 == 0, "89").otherwise("CWE-89").alias("cwe"))
    return validate.rules(rows).select("event_id", "errors")


@query(f"{_CODE} SELECT event_id, array_to_string(list_sort(CASE WHEN path LIKE '%.py' THEN {_ALL(words.SOURCES['python'])} ELSE {_ALL(words.SOURCES['typescript'])} END), ',') AS variables FROM c")
def tainted_variables(spark, sf_dir):
    rows = code(spark, sf_dir)
    found = F.when(F.col("path").endswith(".py"), words.tainted(F.col("text"), "python")).otherwise(words.tainted(F.col("text"), "typescript"))
    return rows.select("event_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("variables"))


@query(f"SELECT event_id, a AS allow_repo, b AS allow_package, CASE WHEN regexp_matches(value, '^([.]/|make|cmake)') THEN a ELSE b AND regexp_matches(value, '^(npm|go) ') END AS is_allowed FROM {samples.duck(samples.COMMAND)}, (VALUES (true), (false)) x(a), (VALUES (true), (false)) y(b)")
def build_command_policies(spark, sf_dir):
    """All four policies over all commands."""
    rows = samples.made(findings(spark, sf_dir), "event_id", command=samples.COMMAND)
    each = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("allow_repo")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("allow_package"))
    return validate.build_commands(each, F.col("allow_repo"), F.col("allow_package")).select("event_id", "allow_repo", "allow_package", "is_allowed")
