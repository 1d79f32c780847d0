"""Rules and analyses over source text, one row a file (path, text) or a line (path, line, text)."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.bitmap import maybe_in, membership
from siltstone.functions import literals, paths, text
from siltstone.scratch import settle
from siltstone.sources.files import lines

AUTH = r"getServerSession|getSession|\bauth\(\)|requireAuth|withAuth|verifyToken"
AUTHZ_TEXTS = ("userId", "ownerId", "hasPermission", "canAccess", "isOwner", "authorize(")
AUTHZ = "|".join(map(re.escape, AUTHZ_TEXTS))
PARAMS = r"\bparams\b"
HTTP = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\b"
FUNCTION = r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\("
DATABASE = r"\b(?:db|prisma)\.\w+\.\w+\("
CALLS = r"\b([a-zA-Z_]\w*)\("
ENTRY = r"@app\.(?:route|get|post|put|delete)|http\.HandleFunc\(|export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|PATCH|DELETE)\b"
SECURITY_TEXT = r"\b(bcrypt|hashlib|jwt|createCipher)"
SECURITY = r"(?i)(^|/)[^/]*(auth|crypto|login|session|password|token)[^/]*$"


#: Rules in one pass over the lines; more go in further passes.
RULE_BLOCK = 500


def apply_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, line, rule_id, severity, cwe): lines that match a rule's pattern (rule_id, pattern, severity, cwe).

    Every line meets every rule, there being no key to join on. The rules, which come
    to the driver, are literals of one expression, so each pattern is compiled once
    and lines go by in one pass for each RULE_BLOCK rules. Patterns are those of
    Java's regular expressions.
    """
    known = rules.select("rule_id", "pattern", "severity", "cwe").collect()
    out = None
    for at in range(0, max(1, len(known)), RULE_BLOCK):
        each = [F.when(F.col("text").rlike(r["pattern"]), F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in ("rule_id", "severity", "cwe")])) for r in known[at : at + RULE_BLOCK]]
        found = F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<rule_id:string,severity:string,cwe:string>>")
        hits = rows.select("path", "line", F.explode(found).alias("r")).select("path", "line", "r.*")
        out = hits if out is None else out.unionByName(hits)
    return out


#: Distinct patterns that a task holds at once; more go in further passes over the lines.
ANCHORS = 1 << 18
#: Lengths of pieces, of which a literal is found by the longest that it has.
PIECES = (literals.LEAST, 6, 12)


def _pieces(column: Column, n: int) -> Column:
    """Every piece of n characters; a shorter text, or none, has none."""
    return F.coalesce(F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), F.array().cast("array<string>"))


#: Signs of a word, in the classes that a pattern may set around it.
SIGNS = ("A-Za-z", "A-Za-z0-9", "A-Za-z0-9_")


def _whole_word(pattern: Column, signs: str) -> Column:
    """The word of ``(^|[^signs])word([^signs]|$)``, which matches just the lines that have it as a run of these signs; else null."""
    form = rf"^\((?:\?:)?\^\|\[\^{signs}\]\)([{signs}]+)\((?:\?:)?\[\^{signs}\]\|\$\)\z"
    return F.nullif(F.regexp_extract(pattern, form, 1), F.lit(""))


def _apply_words(rows: DataFrame, rules: DataFrame, signs: str, least: int) -> DataFrame:
    """As ``apply_rules``, of rules (word, rule_id, severity, cwe) for whole words of ``least`` signs or more."""
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(f"[{signs}]{{{least},}}+"), F.lit(0)))
    near = maybe_in(rows.select("path", "line", F.explode(runs).alias("word")), "word", membership(rules, "word")).filter("_maybe")
    return near.join(rules, "word").select("path", "line", "rule_id", "severity", "cwe")


def apply_many_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``apply_rules``, by an index of the rules, so that a line meets only rules whose text it holds.

    Patterns for a whole word (``_whole_word``) are joined with the words of the lines on equality; a bitmap
    of the rules' words, of bounded size, drops other words where they are read, and nothing comes to the driver.

    Of another pattern a literal that all its matches hold is read off it, and of its pieces (of the longest of PIECES
    that it has) the one that the fewest patterns have is the pattern's anchor. Lines meet by
    equality of their pieces the anchors, which every task holds, so lines are not shuffled; then they hold the literal, then match. Rules of one
    pattern are tried as one and joined to its hits. Patterns without such a literal meet
    every line, in ``apply_rules``. These distinct patterns come to the driver, ANCHORS of them an index and a pass.
    """
    wanted = ["rule_id", "pattern", "severity", "cwe"]
    word = F.coalesce(*[F.when(_whole_word(F.col("pattern"), s).isNotNull(), F.struct(F.lit(s).alias("signs"), _whole_word(F.col("pattern"), s).alias("word"))) for s in SIGNS])
    known = settle(rules.select(*wanted, word.alias("w")).select(*wanted, "w.signs", "w.word"), "rules")
    least = {r["signs"]: r["least"] for r in known.groupBy("signs").agg(F.min(F.length("word")).alias("least")).collect()}
    parts = [_apply_words(rows, known.filter(F.col("signs") == s).select("word", "rule_id", "severity", "cwe"), s, least[s]) for s in SIGNS if s in least]
    if None in least or not parts:
        parts.append(_apply_pieces(rows, known.filter("signs is null").select(*wanted)))
    return reduce(DataFrame.unionByName, parts)


def _apply_pieces(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``apply_many_rules`` of patterns that are not for a whole word."""
    spark = rows.sparkSession
    known = [(r[0], literals.required(r[0] or "")) for r in rules.select("pattern").distinct().collect()]
    cut = lambda lit: next((n for n in reversed(PIECES) if n <= len(lit)), 0)
    pieces = {lit: sorted({lit[i : i + n] for i in range(len(lit) - n + 1)}) if (n := cut(lit)) else [] for _, lit in known}
    common = Counter(p for _, lit in known for p in pieces[lit])
    anchored = [(min(pieces[lit], key=lambda p: (common[p], p)), lit, pattern) for pattern, lit in known if pieces[lit]]
    plain = [(pattern,) for pattern, lit in known if not pieces[lit]]
    out = None
    for at in range(0, max(1, len(anchored)), ANCHORS):
        block = anchored[at : at + ANCHORS]
        anchors = spark.createDataFrame(block, "piece string, literal string, pattern string")
        used = sorted({len(x[0]) for x in block}) or [literals.LEAST]
        own = F.array_distinct(F.concat(*[_pieces(F.col("text"), n) for n in used]))
        met = rows.select("path", "line", "text", F.explode(own).alias("piece")).join(F.broadcast(anchors), "piece")
        found = met.filter(F.col("text").contains(F.col("literal"))).filter(F.expr("rlike(text, pattern)")).select("path", "line", "pattern")
        out = found if out is None else out.unionByName(found)
    hits = out.join(rules.select("rule_id", "pattern", "severity", "cwe"), "pattern").select("path", "line", "rule_id", "severity", "cwe")
    return hits.unionByName(apply_rules(rows, rules.join(F.broadcast(spark.createDataFrame(plain, "pattern string")), "pattern", "left_semi"))) if plain else hits


def taint(files: DataFrame, language: str = "python") -> DataFrame:
    """(path, rule_id, cwe, variable, source_line, sink_line, dataflow): user input that reaches a sink in the same file.

    dataflow has a step (file, line, message, label) for the source and one for the sink.
    Source before sink, the variable named in the sink's line, no sanitizer between
    on a line that names it. One hop, within a file.
    """
    rows = lines(files)
    sources = rows.select("path", F.col("line").alias("source_line"), F.explode(text.tainted(F.col("text"), language)).alias("variable"))
    sinks = None
    for name, (pattern, cwe) in text.SINKS.items():
        part = rows.filter(F.col("text").rlike(pattern)).select("path", F.col("line").alias("sink_line"), F.col("text").alias("sink"), F.lit(f"taint.{name}").alias("rule_id"), F.lit(cwe).alias("cwe"))
        sinks = part if sinks is None else sinks.unionByName(part)
    words = sinks.select("*", F.explode(F.array_distinct(F.regexp_extract_all("sink", F.lit(r"(\w+)"), F.lit(1)))).alias("variable"))
    flows = sources.join(words, ["path", "variable"]).filter("source_line < sink_line")
    cleaned = rows.filter(F.col("text").rlike(text.SANITIZERS)).select("path", F.col("line").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("variable"))
    between = (flows["path"] == cleaned["path"]) & (flows["variable"] == cleaned["variable"]) & (cleaned["at"] > flows["source_line"]) & (cleaned["at"] <= flows["sink_line"])
    step = lambda line, label: F.struct(F.col("path").alias("file"), F.col(line).alias("line"), F.concat(F.lit(f"{label}: "), "variable").alias("message"), F.lit(label).alias("label"))
    found = flows.join(cleaned, between, "left_anti")
    return found.select("path", "rule_id", "cwe", "variable", "source_line", "sink_line", F.array(step("source_line", "source"), step("sink_line", "sink")).alias("dataflow"))


def word_flows(files: DataFrame) -> DataFrame:
    """(path, source_line, sink_line, variable) of files (path, text): a word that opens a line and stands in a later line, with the nearest such line before.

    No line of a sanitizer that names the word lies between or is the sink's. The opening
    words of a file are known before its lines are taken apart, so a line gives a row
    only for each of these that it has. One pass over the lines of each word and file in
    order, so a word that opens many lines costs no more than those lines.
    """
    opening = r"^([A-Za-z]+)(?:\W|$)"
    opens = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?m){opening}"), F.lit(1)))
    # What a generator makes is made once: else the words would be sought for each line again.
    whole = files.select("path", F.explode(F.array(F.struct(opens.alias("opens"), F.split("text", "\n").alias("lines")))).alias("f")).filter(F.size("f.opens") > 0)
    rows = whole.select("path", F.col("f.opens").alias("opens"), F.posexplode("f.lines").alias("at", "text"))
    named = F.array_intersect(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)), F.col("opens"))
    lines_ = rows.select("path", (F.col("at") + 1).alias("line"), F.regexp_extract("text", opening, 1).alias("opening"), F.col("text").rlike(text.SANITIZERS).alias("cleans"), named.alias("named"))
    uses = lines_.select("path", "line", "opening", "cleans", F.explode("named").alias("variable")).withColumn("opens", F.col("opening") == F.col("variable"))
    before = Window.partitionBy("path", "variable").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path", "variable").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    found = uses.withColumns({"source_line": F.max(F.when(F.col("opens"), F.col("line"))).over(before), "cleaned": F.max(F.when(F.col("cleans"), F.col("line"))).over(upto)})
    kept = found.filter(F.col("source_line").isNotNull() & (F.col("cleaned").isNull() | (F.col("cleaned") <= F.col("source_line"))))
    return kept.select("path", "source_line", F.col("line").alias("sink_line"), "variable")


def functions(files: DataFrame) -> DataFrame:
    """(name, path, is_service, has_db_query, has_ownership_check); the flags are of the file."""
    return files.select(
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FUNCTION), F.lit(1)))).alias("name"),
        "path",
        F.col("path").rlike(r"service").alias("is_service"),
        F.col("text").rlike(DATABASE).alias("has_db_query"),
        F.col("text").rlike(AUTHZ).alias("has_ownership_check"),
    )


def routes(files: DataFrame) -> DataFrame:
    """(path, url, methods, calls, has_auth, has_authz, has_params) of route files."""
    return files.filter(F.col("path").rlike(r"(^|/)route\.[jt]sx?$")).select(
        "path",
        paths.route_url(F.col("path")).alias("url"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(HTTP), F.lit(1)))).alias("methods"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(CALLS), F.lit(1)))).alias("calls"),
        F.col("text").rlike(AUTH).alias("has_auth"),
        F.col("text").rlike(AUTHZ).alias("has_authz"),
        F.col("text").rlike(PARAMS).alias("has_params"),
    )


def missing_authorization(route_rows: DataFrame, index: DataFrame) -> DataFrame:
    """(path, name, cwe): routes that call a service function which queries without an ownership check."""
    calls = route_rows.filter("not has_authz").select("path", F.explode("calls").alias("name"))
    risky = index.filter("is_service and has_db_query and not has_ownership_check").select("name").distinct()
    return calls.join(risky, "name", "left_semi").select("path", "name", F.lit("CWE-862").alias("cwe"))


def protected(urls: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Adds is_protected: a prefix (without its glob) starts the url; an empty one never does.

    Urls are cut to each length that a prefix has, so this is a join on equality
    and needs no nested loop.
    """
    plain = prefixes.select(F.regexp_replace("prefix", r"/?:\w+\*?$|/?\*+$", "").alias("p")).filter("p != ''").distinct()
    sizes = plain.agg(F.coalesce(F.collect_set(F.length("p")), F.array().cast("array<int>")).alias("sizes"))
    cut = urls.select("url").distinct().crossJoin(F.broadcast(sizes)).select("url", F.explode("sizes").alias("n")).filter(F.length("url") >= F.col("n"))
    hit = cut.select("url", F.substring("url", F.lit(1), F.col("n")).alias("p")).join(plain, "p", "left_semi").select("url").distinct().withColumn("_hit", F.lit(True))
    return urls.join(hit, "url", "left").withColumn("is_protected", F.coalesce("_hit", F.lit(False))).drop("_hit")


def auth_coverage(route_rows: DataFrame) -> DataFrame:
    """One row: total_routes, protected_routes, unprotected_routes, idor_candidates."""
    safe = F.col("has_auth") | F.col("is_protected")
    return route_rows.agg(
        F.count(F.lit(1)).alias("total_routes"),
        F.count_if(safe).alias("protected_routes"),
        F.count_if(~safe).alias("unprotected_routes"),
        F.count_if(safe & F.col("has_params") & ~F.col("has_authz")).alias("idor_candidates"),
    )


def rbac(files: DataFrame) -> DataFrame:
    """(path, rule_id, cwe): admin checks not tied to a team, and lists without a condition."""
    role = F.regexp_extract_all("text", F.lit(r"(findFirst\(\{[\s\S]*?\}\s*\}\s*\))"), F.lit(1))
    loose = F.exists(role, lambda m: m.rlike(r"role\s*:") & m.rlike("(?i)admin") & ~m.rlike(r"teamId|orgId|projectId|workspaceId"))
    bare = F.col("text").rlike(r"findMany\(\s*(?:\{\s*\})?\s*\)")
    found = F.array_compact(F.array(F.when(loose, F.struct(F.lit("rbac.unscoped-admin-check").alias("rule_id"), F.lit("CWE-863").alias("cwe"))), F.when(bare, F.struct(F.lit("rbac.unscoped-list-endpoint").alias("rule_id"), F.lit("CWE-862").alias("cwe")))))
    return files.select("path", F.explode(found).alias("f")).select("path", "f.*")


def entry_points(rows: DataFrame) -> DataFrame:
    """(path, line) of request handlers."""
    return rows.filter(F.col("text").rlike(ENTRY)).select("path", "line")


def security_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").rlike(SECURITY) | F.col("text").rlike(SECURITY_TEXT)).select("path")


def reachability(findings: DataFrame, entries: DataFrame, near: int = 10) -> DataFrame:
    """Adds is_reachable, reach_confidence and reason: high within ``near`` lines after an entry point of the file."""
    both = findings.select(F.col("file").alias("path"), F.col("start_line").alias("line"), F.lit(None).cast("int").alias("entry"), F.struct("*").alias("f")).unionByName(
        entries.select("path", "line", F.col("line").alias("entry")), allowMissingColumns=True
    )
    # Entry points and findings of a file in line order: the last entry before each finding.
    w = Window.partitionBy("path").orderBy("line", F.col("entry").isNull())
    every = Window.partitionBy("path")
    rows = both.withColumns({"last": F.last("entry", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "any": F.count("entry").over(every)}).filter("f is not null")
    close = F.coalesce(F.col("line") - F.col("last") <= near, F.lit(False))
    reason = F.when(close, "near_entry_point").when(F.col("any") > 0, "far_from_entry_point").otherwise("no_entry_points_detected")
    return rows.select("f.*", F.lit(True).alias("is_reachable"), F.when(close, "high").when(F.col("any") > 0, "medium").otherwise("low").alias("reach_confidence"), reason.alias("reason"))


def project(files: DataFrame) -> DataFrame:
    """One row: languages (name, files), frameworks, archetype."""
    named = files.select(paths.language(F.col("path")).alias("language"), "path", "text")
    per = named.filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files")).agg(F.array_sort(F.collect_list(F.struct("language", "files"))).alias("languages"))
    marks = {"nextjs": r"next/server", "flask": r"from flask", "express": r"require\(.express.\)", "spring": r"org\.springframework"}
    found = named.agg(*[F.coalesce(F.bool_or(F.col("text").rlike(p)), F.lit(False)).alias(n) for n, p in marks.items()], F.coalesce(F.bool_or(F.col("text").rlike(r"argparse|click\.command|int main\(")), F.lit(False)).alias("cli"))
    frameworks = F.array_compact(F.array(*[F.when(F.col(n), n) for n in marks]))
    kind = F.when(F.size(frameworks) > 0, "web-app").when(F.col("cli"), "cli-tool").otherwise("library")
    return per.crossJoin(found).select("languages", frameworks.alias("frameworks"), kind.alias("archetype"))


#: Lines after a label on which a finding still meets it.
MET_AFTER = 2


def corpus_scores(findings: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, n_lines, labels, missed, false_positives, precision, recall).

    A label is met by a finding of its rule on its line or the two after; a finding
    on an ``ok`` line is false. sizes: (path, n_lines). A finding stands for the three
    lines that it can meet, so labels are joined by equality.
    """
    want = labels.filter("polarity = 'ruleid'").select("path", "rule_id", F.col("line").alias("at"))
    rows = findings.select("path", "line", "rule_id").distinct()
    met = rows.select("path", "rule_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MET_AFTER)), lambda k: F.col("line") - k)).alias("at")).distinct().withColumn("met", F.lit(1))
    recall = want.join(met, ["path", "rule_id", "at"], "left").groupBy("path").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("met").isNull()).alias("missed"))
    bad = labels.filter("polarity = 'ok'").join(rows, ["path", "rule_id", "line"], "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("false_positives"))
    out = sizes.join(recall, "path", "left").join(bad, "path", "left").na.fill(0, ["labels", "missed", "false_positives"])
    return out.select(
        "path", "n_lines", "labels", "missed", "false_positives",
        F.round(1 - F.col("false_positives") / F.greatest("n_lines", F.lit(1)), 6).alias("precision"),
        F.round(1 - F.col("missed") / F.greatest("labels", F.lit(1)), 6).alias("recall"),
    )


def corpus_report(scores: DataFrame) -> DataFrame:
    """Overall (files, n_lines, labels, missed, false_positives, precision, recall) of the scores of a corpus."""
    sums = scores.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_lines", "labels", "missed", "false_positives")])
    return sums.withColumns({"precision": F.round(1 - F.col("false_positives") / F.greatest("n_lines", F.lit(1)), 6), "recall": F.round(1 - F.col("missed") / F.greatest("labels", F.lit(1)), 6)})


def rule_coverage(rules: DataFrame, labels: DataFrame) -> DataFrame:
    """(language, total_rules, covered_rules) of each language and overall (NULL): covered rules have an annotation."""
    seen = labels.filter("polarity = 'ruleid'").select("rule_id").distinct().withColumn("_seen", F.lit(True))
    rows = rules.join(seen, "rule_id", "left")
    return rows.rollup("language").agg(F.count(F.lit(1)).alias("total_rules"), F.count_if(F.col("_seen").isNotNull()).alias("covered_rules"))
