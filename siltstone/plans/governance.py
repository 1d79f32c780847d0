"""Queries: fingerprints, filters, baseline, suppressions, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import identity, languages, paths
from siltstone.operators import baseline, filters, report, triage, validate
from siltstone.plans import samples
from siltstone.plans.catalogue import findings, query

_V2 = "'sha256:' || sha256(concat_ws(chr(1), 'v2', file, rule_id, cwe, trim(regexp_replace(snippet, '\\s+', ' ', 'g'))))"
_V1 = "'sha256:' || sha256(concat_ws(chr(1), 'v1', file, start_line::VARCHAR, rule_id))"
_PRINTED = f"p AS (SELECT *, {_V2} AS fingerprint, {_V1} AS fingerprint_v1 FROM f)"
_TEST, _MADE = f"regexp_matches(file, '{paths.TEST}')", f"regexp_matches(file, '{paths.GENERATED}')"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_REDUCED = "CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'info' END"
AS_OF = "2024-06-01"
_LIVE = f"(expires_at IS NULL OR expires_at >= DATE '{AS_OF}')"
# Every ninth finding was suppressed, some twice with another end.
_HELD = "s AS (SELECT fingerprint, 'r' || (event_id % 5) AS reason, 'owner' AS owner, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN DATE '2020-01-01' ELSE DATE '2099-12-31' END AS expires_at, event_id AS seq FROM p WHERE event_id % 9 = 0)"
_CURRENT = "c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq DESC) = 1)"


def printed(spark, sf_dir):
    fp = identity.fingerprint(F.col("file"), F.col("rule_id"), F.array("cwe"), F.col("snippet"), F.col("start_line"), F.col("start_line"))
    return findings(spark, sf_dir).withColumns({"fingerprint": fp, "fingerprint_v1": identity.fingerprint_v1(F.col("file"), F.col("start_line"), F.col("rule_id"))})


def held(spark, sf_dir):
    ends = F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("date")).when(F.col("event_id") % 4 == 1, F.to_date(F.lit("2020-01-01"))).otherwise(F.to_date(F.lit("2099-12-31")))
    rows = printed(spark, sf_dir).filter("event_id % 9 = 0")
    return rows.select("fingerprint", F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("reason"), F.lit("owner").alias("owner"), ends.alias("expires_at"), F.col("event_id").alias("seq"))


def known(spark, sf_dir):
    """Baseline of the first half of the month, without the findings of a third of the files."""
    rows = printed(spark, sf_dir).filter("scan_date < date '2024-01-15' and length(file) % 3 <> 0")
    return rows.groupBy("fingerprint").agg(F.min("ts").alias("first_seen"))


_KNOWN = "k AS (SELECT fingerprint, min(ts) AS first_seen FROM p WHERE scan_date < DATE '2024-01-15' AND length(file) % 3 <> 0 GROUP BY fingerprint)"
as_of = lambda: F.to_date(F.lit(AS_OF))


@query(f"SELECT event_id, {_V1} AS fingerprint FROM f")
def fingerprint_v1(spark, sf_dir):
    return printed(spark, sf_dir).select("event_id", F.col("fingerprint_v1").alias("fingerprint"))


@query(f"SELECT event_id, {_V2} AS fingerprint FROM f")
def fingerprint_v2(spark, sf_dir):
    return printed(spark, sf_dir).select("event_id", "fingerprint")


# Filters.


@query(f"SELECT event_id, file FROM f WHERE NOT {_TEST} AND NOT {_MADE}")
def filter_generated(spark, sf_dir):
    return filters.fast(findings(spark, sf_dir)).select("event_id", "file")


@query(f"SELECT event_id, file, {_TEST} AS is_test, {_MADE} AS is_generated FROM (SELECT event_id, value AS file FROM {samples.duck(samples.ANY_PATH)})")
def path_predicates(spark, sf_dir):
    rows = samples.made(findings(spark, sf_dir), "event_id", file=samples.ANY_PATH)
    return rows.select("event_id", "file", paths.is_test(F.col("file")).alias("is_test"), paths.is_generated(F.col("file")).alias("is_generated"))


_SOFT = f"""SELECT event_id, CASE WHEN {_TEST} THEN {_REDUCED} ELSE severity END AS severity, CASE WHEN {_TEST} THEN severity END AS original_severity, CASE WHEN {_TEST} THEN 'test_code' END AS context,
 is_suppressed OR {_MADE} AS is_suppressed"""


@query(f"{_SOFT}, CASE WHEN {_MADE} THEN 'false-positive' WHEN {_TEST} THEN 'needs-review' ELSE 'active' END AS triage_status FROM f")
def soft_filter(spark, sf_dir):
    return filters.soft(findings(spark, sf_dir)).select("event_id", "severity", "original_severity", "context", "is_suppressed", "triage_status")


_SCORE = "least(1.0, CASE confidence WHEN 'high' THEN 0.7 WHEN 'low' THEN 0.3 ELSE 0.5 END::DOUBLE + CASE WHEN n_steps > 0 THEN 0.2 ELSE 0.0 END::DOUBLE)::DOUBLE"


@query(f"{_SOFT}, {_SCORE} AS confidence_score, CASE WHEN {_MADE} THEN 'false-positive' WHEN {_SCORE} <= 0.5 THEN 'needs-review' ELSE 'active' END AS triage_status FROM f WHERE NOT {_TEST}")
def soft_filter_scored(spark, sf_dir):
    rows = filters.soft(findings(spark, sf_dir), {"test_code": "skip", "confidence_scoring": {"enabled": True}})
    return rows.select("event_id", "severity", "original_severity", "context", "is_suppressed", "confidence_score", "triage_status")


@query("SELECT event_id, 'python' AS language FROM f WHERE file LIKE '%.py'")
def language_filter(spark, sf_dir):
    return filters.of_languages(findings(spark, sf_dir), "py", ["python", "typescript"]).select("event_id", "language")


_LISTS = (["python", "Python", "go"], ["typescript", "javascript"], ["kotlin", "java", "brainfuck"], ["brainfuck"])
_NAMES = (["python", "go"], ["javascript"], ["java"], [])


@query(f"SELECT event_id, [{', '.join(str(n) for n in _NAMES[:3])}, list_filter(['x'], lambda y: false)][event_id % 4 + 1] AS names FROM f")
def resolve_languages(spark, sf_dir):
    lists = F.array(*[F.array(*[F.lit(x) for x in names]) for names in _LISTS])
    return findings(spark, sf_dir).select("event_id", languages.canonical(F.get(lists, (F.col("event_id") % 4).cast("int"))).alias("names"))


@query("SELECT event_id FROM f WHERE file IN (SELECT file FROM f WHERE event_id % 97 = 0)")
def changed_only(spark, sf_dir):
    rows = findings(spark, sf_dir)
    return filters.changed_only(rows, rows.filter("event_id % 97 = 0").select("file").distinct()).select("event_id")


@query("SELECT event_id, severity FROM f WHERE severity = 'high'")
def triage_focus(spark, sf_dir):
    return filters.focused(findings(spark, sf_dir), "high").select("event_id", "severity")


@query(f"SELECT count(*) FILTER (WHERE NOT is_suppressed AND status <> 'false-positive' AND {_RANK} >= 3) AS unfixed_high FROM f")
def unfixed_high(spark, sf_dir):
    return filters.unfixed_high(findings(spark, sf_dir))


@query(
    """SELECT event_id, list_filter([CASE WHEN event_id % 5 = 0 THEN 'severity' END, CASE WHEN event_id % 7 = 0 THEN 'triage.status' END, CASE WHEN event_id % 11 = 0 THEN 'title' END], lambda x: x IS NOT NULL) AS errors,
    event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS is_valid FROM f"""
)
def llm_validate(spark, sf_dir):
    rows = findings(spark, sf_dir)
    broken = rows.withColumns({"severity": F.when(F.col("event_id") % 5 == 0, "urgent").otherwise(F.col("severity")), "status": F.when(F.col("event_id") % 7 == 0, "bogus").otherwise(F.col("status")), "title": F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("rule_id"))})
    return validate.llm_findings(broken).select("event_id", "errors", "is_valid")


# Baseline and suppressions.


@query(f"WITH {_PRINTED}, {_KNOWN} SELECT event_id, fingerprint NOT IN (SELECT fingerprint FROM k) AS is_new FROM p")
def baseline_new(spark, sf_dir):
    return baseline.marked(printed(spark, sf_dir), known(spark, sf_dir)).select("event_id", "is_new")


@query(f"WITH {_PRINTED}, {_KNOWN} SELECT event_id FROM p WHERE fingerprint NOT IN (SELECT fingerprint FROM k)")
def baseline_new_only(spark, sf_dir):
    return baseline.new_only(printed(spark, sf_dir), known(spark, sf_dir)).select("event_id")


@query(f"WITH {_PRINTED}, {_HELD}, {_CURRENT} SELECT event_id, c.fingerprint IS NOT NULL AS is_suppressed, c.reason AS suppression_reason FROM p LEFT JOIN c ON p.fingerprint = c.fingerprint AND {_LIVE}")
def suppressed_active(spark, sf_dir):
    return baseline.suppressed(printed(spark, sf_dir), held(spark, sf_dir), as_of()).select("event_id", "is_suppressed", "suppression_reason")


@query(f"WITH {_PRINTED}, {_HELD}, {_CURRENT} SELECT count(*) AS total, count(*) FILTER (WHERE NOT {_LIVE}) AS expired, count(*) FILTER (WHERE expires_at IS NULL) AS permanent, count(*) FILTER (WHERE {_LIVE}) AS active FROM c")
def baseline_stats(spark, sf_dir):
    return baseline.stats(baseline.current(held(spark, sf_dir)), as_of())


@query(f"WITH {_PRINTED}, b AS (SELECT DISTINCT fingerprint FROM p WHERE scan_date = DATE '2024-01-10'), a AS (SELECT DISTINCT fingerprint FROM p WHERE scan_date = DATE '2024-01-11') SELECT fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'added' WHEN a.fingerprint IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM b FULL JOIN a USING (fingerprint)")
def baseline_diff(spark, sf_dir):
    rows = printed(spark, sf_dir)
    return baseline.diff(rows.filter("scan_date = date '2024-01-10'"), rows.filter("scan_date = date '2024-01-11'"))


def _changes(kind: str, before: str, after: str) -> str:
    return f"SELECT '{kind}' AS kind, fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'added' WHEN a.fingerprint IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM ({before}) b FULL JOIN ({after}) a USING (fingerprint)"


@query(
    f"WITH {_PRINTED}, {_HELD} {_changes('fingerprint', 'SELECT DISTINCT fingerprint FROM p WHERE ts < TIMESTAMP \'2024-01-15\'', 'SELECT DISTINCT fingerprint FROM p WHERE ts >= TIMESTAMP \'2024-01-10\'')}"
    f" UNION ALL {_changes('suppression', 'SELECT DISTINCT fingerprint FROM s WHERE seq % 4 < 2', 'SELECT DISTINCT fingerprint FROM s WHERE seq % 4 > 0')}"
)
def baseline_diff_all(spark, sf_dir):
    """Baselines of the days before the 15th and from the 10th on, with suppressions that come, go and stay."""
    rows, kept = printed(spark, sf_dir), held(spark, sf_dir)
    return baseline.diff_all(rows.filter("scan_date < date '2024-01-15'"), rows.filter("scan_date >= date '2024-01-10'"), kept.filter("seq % 4 < 2"), kept.filter("seq % 4 > 0"))


@query(f"WITH {_PRINTED} SELECT fingerprint FROM p UNION SELECT fingerprint_v1 FROM p")
def baseline_keys(spark, sf_dir):
    return baseline.keys(printed(spark, sf_dir))


@query(f"WITH {_PRINTED}, {_KNOWN}, n AS (SELECT fingerprint FROM p UNION SELECT fingerprint_v1 FROM p) SELECT fingerprint, least(first_seen, CASE WHEN n.fingerprint IS NOT NULL THEN TIMESTAMP '2024-02-01' END) AS first_seen FROM k FULL JOIN n USING (fingerprint)")
def baseline_update(spark, sf_dir):
    return baseline.updated(known(spark, sf_dir), printed(spark, sf_dir), F.to_timestamp(F.lit("2024-02-01 00:00:00")))


@query(f"WITH {_PRINTED}, {_HELD}, {_CURRENT} SELECT fingerprint, reason, owner, expires_at, seq FROM c")
def suppression_upsert(spark, sf_dir):
    rows = held(spark, sf_dir)
    return baseline.add(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"))


@query(f"WITH {_PRINTED}, {_HELD} SELECT seq, 'remove_suppression' AS action, fingerprint FROM s WHERE seq % 2 = 0 UNION ALL SELECT seq, 'add_suppression', fingerprint FROM s")
def suppression_audit(spark, sf_dir):
    rows = held(spark, sf_dir)
    trail = rows.select("seq", F.lit("add_suppression").alias("action"), "fingerprint")
    return baseline.with_audit(trail, rows.filter("seq % 2 = 0"), "remove_suppression")


@query(f"WITH {_PRINTED}, {_HELD} SELECT seq, fingerprint FROM s WHERE fingerprint NOT IN (SELECT fingerprint FROM s WHERE seq % 4 = 0)")
def suppression_remove(spark, sf_dir):
    rows = held(spark, sf_dir)
    return baseline.remove(rows, rows.filter("seq % 4 = 0").select("fingerprint").distinct()).select("seq", "fingerprint")


@query(f"WITH {_PRINTED}, {_HELD}, m AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY seq) AS n FROM s WHERE seq % 2 = 1) SELECT CASE WHEN n = 1 AND fingerprint NOT IN (SELECT fingerprint FROM s WHERE seq % 2 = 0) THEN 'imported' ELSE 'skipped' END AS outcome, count(*) AS n FROM m GROUP BY 1")
def import_suppressions(spark, sf_dir):
    rows = held(spark, sf_dir)
    return baseline.imported(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PRINTED}, {_HELD} SELECT fingerprint, seq FROM s WHERE NOT {_LIVE}")
def cleanup_expired(spark, sf_dir):
    return baseline.cleaned(held(spark, sf_dir), as_of())[1].select("fingerprint", "seq")


@query(f"WITH {_PRINTED}, {_HELD} SELECT seq, fingerprint FROM s ORDER BY seq DESC LIMIT 50")
def audit_trail(spark, sf_dir):
    return baseline.audit_trail(held(spark, sf_dir).select("seq", "fingerprint"))


# Triage.

_BUCKET = f"CASE WHEN status = 'false-positive' OR is_suppressed THEN 'false_positive' WHEN status = 'needs-review' THEN 'needs_review' WHEN {_RANK} >= 3 THEN 'priority' WHEN {_RANK} >= 2 THEN 'important' ELSE 'needs_review' END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM f GROUP BY 1")
def triage_buckets(spark, sf_dir):
    return triage.buckets(findings(spark, sf_dir))


@query(f"SELECT event_id, severity FROM f ORDER BY {_RANK} DESC, event_id LIMIT 100")
def priority_topk(spark, sf_dir):
    return triage.priority_list(findings(spark, sf_dir)).select("event_id", "severity").limit(100)


@query(f"SELECT 'T-' || printf('%03d', row_number() OVER (ORDER BY {_RANK} DESC, event_id)) AS target_id, event_id FROM f QUALIFY row_number() OVER (ORDER BY {_RANK} DESC, event_id) <= 20")
def plan_targets(spark, sf_dir):
    from siltstone.functions import severity

    return triage.numbered(findings(spark, sf_dir), [severity.rank(F.col("severity")).desc(), F.col("event_id")], 20).select("target_id", "event_id")


_VERDICTS = "v AS (SELECT fingerprint, CASE WHEN min(event_id) % 2 = 0 THEN 'TP' ELSE 'FP' END AS verdict, (min(event_id) % 10)::DOUBLE / 10 AS vc FROM p WHERE event_id % 3 = 0 GROUP BY fingerprint)"
_JUDGED = f"WITH {_PRINTED}, {_VERDICTS}, j AS (SELECT p.event_id, CASE verdict WHEN 'TP' THEN 'confirmed' WHEN 'FP' THEN 'false-positive' ELSE status END AS status, vc, CASE WHEN verdict IS NOT NULL THEN '2024-02-01T00:00:00Z' END AS validated_at FROM p LEFT JOIN v USING (fingerprint))"


def _judged(spark, sf_dir):
    rows = printed(spark, sf_dir)
    first = rows.filter("event_id % 3 = 0").groupBy("fingerprint").agg(F.min("event_id").alias("m"))
    verdicts = first.select("fingerprint", F.when(F.col("m") % 2 == 0, "TP").otherwise("FP").alias("verdict"), ((F.col("m") % 10).cast("double") / 10).alias("verdict_confidence"), F.lit("seen").alias("rationale"))
    return triage.with_verdicts(rows, verdicts, "2024-02-01T00:00:00Z")


@query(_JUDGED + " SELECT event_id, status, validated_at FROM j")
def apply_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("event_id", "status", "validated_at")


@query(_JUDGED + " SELECT event_id FROM j WHERE status = 'false-positive' AND vc >= 0.5")
def export_triage(spark, sf_dir):
    return triage.exported(_judged(spark, sf_dir), 0.5).select("event_id")


@query(f"WITH {_PRINTED}, b AS (SELECT DISTINCT fingerprint FROM p WHERE scan_date = DATE '2024-01-10'), a AS (SELECT DISTINCT fingerprint FROM p WHERE scan_date = DATE '2024-01-11') SELECT (SELECT min(fingerprint) FROM b) NOT IN (SELECT fingerprint FROM a) AS resolved, (SELECT count(*) FROM a WHERE fingerprint NOT IN (SELECT fingerprint FROM b)) AS new_findings_count")
def fix_validation(spark, sf_dir):
    rows = printed(spark, sf_dir)
    before, after = rows.filter("scan_date = date '2024-01-10'"), rows.filter("scan_date = date '2024-01-11'")
    return triage.fix_validation(before, after, before.agg(F.min("fingerprint").alias("fingerprint")))


_TARGETS = "t AS (SELECT url_id AS target, file, risks FROM (SELECT page_id AS url_id, CASE WHEN page_id % 4 = 0 THEN 'app/api/auth/p' || page_id ELSE 'app/p' || page_id END AS file, [['idor-risk'], ['missing-csrf'], ['missing-authentication', 'idor-risk'], ['other']][page_id % 4 + 1] AS risks FROM pages))"


def _targets(spark, sf_dir):
    from siltstone.sources import tables

    risks = F.array(*[F.array(*[F.lit(x) for x in r]) for r in (["idor-risk"], ["missing-csrf"], ["missing-authentication", "idor-risk"], ["other"])])
    rows = tables.load(spark, sf_dir, "pages")
    at = F.col("page_id").cast("string")
    return rows.select(F.col("page_id").alias("target"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("app/api/auth/p"), at)).otherwise(F.concat(F.lit("app/p"), at)).alias("file"), F.get(risks, (F.col("page_id") % 4).cast("int")).alias("risks"))


@query(f"WITH {_TARGETS} SELECT target, CASE target % 4 WHEN 0 THEN 2.0 - 2.0 WHEN 1 THEN 0.5 WHEN 2 THEN 3.5 ELSE 1.0 END::DOUBLE - CASE WHEN target % 6 = 1 THEN 2.0 ELSE 0.0 END::DOUBLE AS score FROM t")
def target_priority(spark, sf_dir):
    rows = _targets(spark, sf_dir)
    return triage.prioritized(rows, rows.filter("target % 6 = 1").select("file")).select("target", F.round("score", 6).alias("score"))


@query(f"WITH {_TARGETS} SELECT target, CASE WHEN target % 3 = 0 THEN list_sort(list_filter(risks, lambda x: x <> 'idor-risk')) ELSE list_sort(risks) END AS to_analyze, target % 3 = 0 AND target % 4 = 0 AS skip FROM t")
def analysis_checklist(spark, sf_dir):
    rows = _targets(spark, sf_dir)
    covered = rows.filter("target % 3 = 0").select("file", F.lit("idor-risk").alias("risk"))
    return triage.checklist(rows, covered).select("target", "to_analyze", "skip")


@query(f"SELECT true AS scan_complete, count(*) FILTER (WHERE NOT is_suppressed AND status <> 'false-positive' AND {_RANK} >= 3) AS unfixed_high, (SELECT count(*) FROM pages WHERE page_id % 5 <> 0) AS pending_targets FROM f")
def session_status(spark, sf_dir):
    return triage.session_status(findings(spark, sf_dir), _targets(spark, sf_dir).withColumn("done", F.col("target") % 5 == 0))


# A session for each user: of some the scan, the plan or the model's answer is not there yet.
@query(
    f"""WITH u AS (SELECT DISTINCT user_id AS session_id FROM events), p AS (SELECT session_id, session_id % 3 = 0 AS planned, session_id % 4 > 0 AS scanned, session_id % 5 > 1 AS analyzed FROM u),
    g AS (SELECT user_id AS session_id, count(*) FILTER (WHERE NOT is_suppressed AND status <> 'false-positive' AND {_RANK} >= 3) AS n FROM f JOIN events USING (event_id) WHERE is_new GROUP BY 1),
    s AS (SELECT session_id, scanned, analyzed, CASE WHEN scanned THEN 'quick' END AS profile, greatest(CASE WHEN planned THEN session_id % 6 + 1 ELSE 0 END - CASE WHEN analyzed THEN session_id % 5 - 2 ELSE 0 END, 0) AS pending, coalesce(n, 0) AS n,
      list_sort(list_distinct(list_filter([CASE WHEN planned THEN 'plan' END, CASE WHEN scanned THEN 'scan' END, CASE WHEN analyzed AND session_id % 2 = 1 THEN 'phase_a' END, CASE WHEN analyzed AND session_id % 5 > 2 THEN 'phase_b' END], lambda x: x IS NOT NULL))) AS phases
      FROM p LEFT JOIN g USING (session_id) WHERE scanned OR planned OR analyzed OR n IS NOT NULL),
    d AS (SELECT *, list_filter([CASE WHEN NOT scanned THEN 'run a sast-scan' END, CASE WHEN pending > 0 THEN 'analyze the discover targets left' END, CASE WHEN n > 0 THEN 'triage and fix the high findings' END], lambda x: x IS NOT NULL) AS due FROM s)
    SELECT session_id, profile, scanned AS scan_complete, analyzed AS llm_findings_present, pending::BIGINT AS pending_discover, n AS unfixed_high, phases AS completed_phases, CASE WHEN len(due) > 0 THEN due ELSE ['refresh the baseline'] END AS next_steps FROM d"""
)
def sessions(spark, sf_dir):
    from siltstone.sources import tables

    events = tables.load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"))
    ids = events.select("session_id").distinct()
    at = F.col("session_id")
    scans = ids.filter("session_id % 4 > 0").select("session_id", F.lit("quick").alias("profile"))
    plans = ids.filter("session_id % 3 = 0").select("session_id", F.array(F.lit("plan")).alias("completed_phases"), (at % 6 + 1).alias("n_discover"))
    analyses = ids.filter("session_id % 5 > 1").select("session_id", (at % 2).alias("n_validated"), (at % 5 - 2).alias("n_discovered"))
    return triage.sessions(scans, plans, findings(spark, sf_dir).filter("is_new").join(events, "event_id"), analyses)


@query(
    f"""SELECT scan, "at", step FROM (SELECT s.scan, t."at", t.step, row_number() OVER (PARTITION BY s.scan ORDER BY t."at") AS n
      FROM (SELECT u.event_id AS scan, count(g.event_id) FILTER (WHERE {_RANK.replace('severity', 'g.severity')} >= 3) AS high, count(g.event_id) FILTER (WHERE g.status = 'needs-review') AS review FROM f u LEFT JOIN f g ON g.file = u.file AND g.start_line = u.start_line AND g.event_id % 3 <> 0 GROUP BY u.event_id) s,
      (VALUES (0, 'fix blocking findings'), (1, 'review findings that need it'), (2, 'refresh the baseline'), (3, 'scan changed-only in continuous integration'), (4, 'update rules')) t("at", step)
      WHERE t."at" > 1 OR (t."at" = 0 AND s.high > 0) OR (t."at" = 1 AND s.review > 0)) WHERE n <= 3"""
)
def next_steps(spark, sf_dir):
    """A scan of each finding's line finds what two thirds of the findings are on it, or nothing."""
    rows = findings(spark, sf_dir)
    scans = rows.select(F.col("event_id").alias("scan"), "file", "start_line")
    found = rows.filter("event_id % 3 <> 0").drop("event_id").join(scans, ["file", "start_line"])
    return triage.next_steps(found, scans.select("scan"))


@query(f"WITH {_PRINTED} SELECT fingerprint AS key, id FROM p WHERE fingerprint IN (SELECT fingerprint FROM p WHERE event_id % 50 = 0) UNION SELECT id, id FROM p WHERE event_id % 50 = 1 UNION SELECT fingerprint_v1, id FROM p WHERE fingerprint_v1 IN (SELECT fingerprint_v1 FROM p WHERE event_id % 50 = 2)")
def find_finding(spark, sf_dir):
    rows = printed(spark, sf_dir)
    part = lambda c, k: rows.filter(f"event_id % 50 = {k}").select(F.col(c).alias("key"))
    return report.lookup_all(rows, part("fingerprint", 0).union(part("id", 1)).union(part("fingerprint_v1", 2)).distinct())


@query(f"WITH {_PRINTED} SELECT event_id, 'sast-fix/' || substr(fingerprint, 1, 12) AS branch FROM p")
def branch_name(spark, sf_dir):
    return printed(spark, sf_dir).select("event_id", identity.branch(F.col("fingerprint")).alias("branch"))


_PROFILES = ("quick", "standard", "deep", "other")


@query("SELECT event_id, ['code-scanning', 'security-extended', 'security-and-quality', NULL][event_id % 4 + 1] AS suite FROM f")
def query_suite(spark, sf_dir):
    return findings(spark, sf_dir).select("event_id", languages.suite(F.get(F.array(*[F.lit(p) for p in _PROFILES]), (F.col("event_id") % 4).cast("int"))).alias("suite"))


@query(f"WITH {_PRINTED}, {_KNOWN}, {_HELD}, {_CURRENT} SELECT (SELECT count(*) FROM k) AS fingerprints, (SELECT count(*) FROM c) AS suppressions")
def baseline_show(spark, sf_dir):
    return baseline.shown(known(spark, sf_dir), baseline.current(held(spark, sf_dir)))


@query(f"WITH g AS (SELECT count(*) FILTER (WHERE is_new AND NOT is_suppressed AND {_RANK} >= 3) AS n FROM f) SELECT 0 AS at, CASE WHEN n = 0 THEN 'strict: passed' ELSE 'strict: blocked by ' || n END AS line FROM g UNION ALL SELECT 5 - {_RANK}, severity || ': ' || count(*) FROM f GROUP BY severity")
def review_comment(spark, sf_dir):
    rows = findings(spark, sf_dir)
    return report.comment_table(rows, triage.gate(rows, "high", review_findings_blocking=True), review_findings_blocking=True)


@query(f"WITH {_PRINTED} SELECT 'scan-' || scan_date AS scan_id, scan_date || 'T00:00:00Z' AS timestamp, count(*)::INTEGER AS total_findings, count(*) FILTER (WHERE severity = 'high')::INTEGER AS high, list_sort(list(DISTINCT fingerprint)) AS fingerprints FROM p GROUP BY scan_date")
def history_entries(spark, sf_dir):
    rows = report.history_entries(printed(spark, sf_dir))
    return rows.select("scan_id", "timestamp", "total_findings", F.coalesce(F.col("severity_counts")["high"], F.lit(0)).alias("high"), "fingerprints")


_CONTEXTS = "CASE WHEN event_id % 2 = 0 THEN 'one,two' ELSE '' END"


@query(
    f"""SELECT event_id, CASE WHEN status = 'false-positive' OR is_suppressed THEN 'false_positive' WHEN status = 'needs-review' THEN 'needs_review' WHEN {_RANK} >= 3 THEN 'priority' WHEN {_RANK} >= 2 THEN 'important' ELSE 'needs_review' END AS bucket,
    {_CONTEXTS} AS lines FROM f"""
)
def bulk_triage(spark, sf_dir):
    """Every finding with its bucket and code; odd ones have no file to read."""
    rows = findings(spark, sf_dir).withColumn("file", F.concat("file", F.lit("#"), F.col("event_id").cast("string"))).withColumn("start_line", F.lit(1))
    sources = rows.filter("event_id % 2 = 0").select(F.col("file").alias("path"), F.lit("one\ntwo").alias("text"))
    return triage.with_context(rows, sources).select("event_id", "bucket", F.array_join(F.transform("lines", lambda x: x["text"]), ",").alias("lines"))


@query("SELECT count(*) AS targets, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS urgent FROM (SELECT file, start_line, rule_id, any_value(severity) AS severity FROM f GROUP BY file, start_line, rule_id)")
def plan_summary(spark, sf_dir):
    from siltstone.operators import dedupe

    rows = dedupe.exact(findings(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("severity").isin("critical", "high")).alias("urgent"))
