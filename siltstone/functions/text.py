"""Extraction from source text, and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Families of secrets, in the order they are replaced. Fixed forms of public credentials.
SECRETS = (
    ("PRIVATE-KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("AWS-KEY", r"AKIA[0-9A-Z]{16}"),
    ("GITHUB-TOKEN", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("BEARER", r"[Bb]earer\s+[A-Za-z0-9._~+/=-]+"),
    ("JWT", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("TOKEN", r'token = "[0-9a-f]{40}"'),
)
#: Language -> assignment of user input to a variable, and inputs that are checked first.
SOURCES = {
    "python": r"(\w+)\s*=\s*(?:request\.(?:args|form|json|values|cookies|headers)|input\()",
    "typescript": r"(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?(?:\w+\.nextUrl\.searchParams|req(?:uest)?\.(?:query|body|params|json|headers))",
}
SINKS = {"sql": (r"\b(?:query|execute|queryRaw|raw)\s*\(", "CWE-89"), "command": (r"\b(?:subprocess\.\w+|os\.system|exec|execSync|spawn)\s*\(", "CWE-78")}
#: Lines that import.
IMPORT = r"^\s*(import\s|from\s+\S+\s+import\s|const .*require\()"
SANITIZERS = r"\.(?:parse|safeParse|escape|quote)\(|sanitize|parseInt|int\("


def redacted(text: Column) -> Column:
    for name, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[REDACTED-{name}]")
    return text


def redacted_evidence(evidence: Column) -> Column:
    steps = F.transform(evidence["dataflow"], lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"), redacted(s["message"]).alias("message"), s["label"].alias("label")))
    return F.struct(redacted(evidence["source"]).alias("source"), redacted(evidence["sink"]).alias("sink"), steps.alias("dataflow"))


#: Escapes of JSON strings and characters that JSON text never holds, to stand for them for a while.
_ESCAPES = (("\\\\", "\x01"), ('\\"', "\x02"), ("\\n", "\x03"), ("\\t", "\x04"), ("\\r", "\x05"))


def redacted_json(value: Column) -> Column:
    """JSON text, as of a SARIF log, redacted inside its strings: never over the end of one, so it stays JSON.

    Escapes count as what they stand for, but for those by code.
    """
    value = F.replace(value, F.lit(_ESCAPES[0][0]), F.lit(_ESCAPES[0][1]))
    value = F.replace(value, F.lit("\\/"), F.lit("/"))
    for escape, stand_in in _ESCAPES[1:]:
        value = F.replace(value, F.lit(escape), F.lit(stand_in))
    for name, pattern in SECRETS:
        inside = pattern.replace('"', "\x02").replace(r"[\s\S]", '[^"]').replace(r"\s", r"[\s\x03-\x05]")
        value = F.regexp_replace(value, inside, f"[REDACTED-{name}]")
    for escape, stand_in in _ESCAPES:
        value = F.replace(value, F.lit(stand_in), F.lit(escape))
    return value


def cwe_numbers(values: Column) -> Column:
    """The first run of digits of each entry, sorted, each once; entries without digits fall out."""
    found = F.transform(values, lambda v: F.regexp_extract(v, r"(\d+)", 1).try_cast("int"))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def tainted(line: Column, language: str) -> Column:
    """Variables that a line fills from user input."""
    return F.regexp_extract_all(line, F.lit(SOURCES["python" if language == "python" else "typescript"]), F.lit(1))


def imports(code: Column) -> Column:
    """Import lines."""
    return F.filter(F.split(code, "\n"), lambda x: x.rlike(IMPORT))


def handlers(code: Column) -> Column:
    """struct(method, start_line, end_line) of exported HTTP handlers; a region ends before the next handler."""
    lines = F.split(code, "\n")
    pattern = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\b"
    numbered = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, pattern, 1).alias("method"), (i + 1).alias("start_line")))
    found = F.filter(numbered, lambda h: h["method"] != "")
    return F.transform(found, lambda h, i: F.struct(h["method"].alias("method"), h["start_line"].alias("start_line"), F.coalesce(F.get(found, i + 1)["start_line"] - 1, F.size(lines)).alias("end_line")))


def middleware(code: Column) -> Column:
    """struct(detected, has_auth_check, prefixes) of a middleware file."""
    matcher = F.regexp_extract(code, r"""matcher\s*:\s*(\[[^\]]*\]|'[^']*'|"[^"]*")""", 1)
    return F.struct(
        F.coalesce(code.rlike(r"function\s+middleware|export\s+default"), F.lit(False)).alias("detected"),
        F.coalesce(code.rlike(r"getServerSession|getToken|withAuth|auth\("), F.lit(False)).alias("has_auth_check"),
        F.regexp_extract_all(matcher, F.lit("""["']([^"']*)["']"""), F.lit(1)).alias("prefixes"),
    )


def context(code: Column, line: Column, around: int = 3) -> Column:
    """struct(line, text, highlight) of the lines around one; an unreadable file gives an empty list."""
    lines = F.split(code, "\n")
    first = F.greatest(line - around, F.lit(1))
    last = F.least(line + around, F.size(lines))
    window = F.when(code.isNotNull() & (first <= last), F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("line"), F.get(lines, i - 1).alias("text"), (i == line).alias("highlight"))))
    return F.coalesce(window, F.array().cast("array<struct<line:int,text:string,highlight:boolean>>"))
