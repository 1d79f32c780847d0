"""Predicates and projections of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]+$|[_.](test|spec)\.[A-Za-z]+$"
GENERATED = r"(^|/)(vendor|node_modules|dist|build|\.gomodcache)/|\.generated\.|\.pb\.go$|\.min\.[A-Za-z]+$"
LEADING = r"^(?:\.{1,2}/|/)+"
# Fixed value: the form of benchmark case names. Numbers are padded to five digits, so from 100,000 on they have more.
TEST_CASE = r"(BenchmarkTest\d{5,})\.java$"
#: Extension -> language.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go",
    "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "rs": "rust", "c": "cpp", "cc": "cpp", "cpp": "cpp",
    "h": "cpp", "cs": "csharp", "swift": "swift", "scala": "scala",
}


def is_test(path: Column) -> Column:
    return path.rlike(TEST)


def is_generated(path: Column) -> Column:
    return path.rlike(GENERATED)


def sanitized(path: Column) -> Column:
    """Without leading ``./``, ``../`` and ``/`` in any mix, so it never leaves the root."""
    return F.regexp_replace(path, LEADING, "")


def resolved(path: Column) -> Column:
    """Without ``.``, ``..`` and empty parts; NULL where ``..`` leaves the root."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part != "..", F.concat(done, F.array(part))).when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def relative(path: Column, root: str) -> Column:
    """Relative to ``root`` where below it, then sanitized."""
    base = root.rstrip("/") + "/"
    return sanitized(F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def top(path: Column) -> Column:
    """First component."""
    return F.split(path, "/")[0]


def test_case(path: Column) -> Column:
    """Name of a benchmark case, NULL for other paths."""
    return F.nullif(F.regexp_extract(path, TEST_CASE, 1), F.lit(""))


def route_url(path: Column) -> Column:
    """``app/api/users/[id]/route.ts`` -> ``/api/users/[id]``; other paths NULL."""
    return F.when(path.rlike(r"(^|/)app/(.*/)?route\.[jt]sx?$"), F.regexp_replace(F.regexp_replace(path, r"^(.*/)?app/", "/"), r"/?route\.[jt]sx?$", ""))
