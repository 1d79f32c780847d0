"""Language names and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"py": "python", "js": "javascript", "ts": "typescript"}
#: Language -> the name the code-query engine knows it by.
CANONICAL = {
    "python": "python", "javascript": "javascript", "typescript": "javascript", "java": "java", "kotlin": "java",
    "go": "go", "ruby": "ruby", "cpp": "cpp", "c": "cpp", "csharp": "csharp", "swift": "swift", "rust": "rust",
}
SUITES = {"quick": "code-scanning", "standard": "security-extended", "deep": "security-and-quality"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def canonical(names: Column) -> Column:
    """Known names only, each once, in order of first appearance."""
    known = F.transform(names, lambda n: F.try_element_at(_map(CANONICAL), F.lower(F.trim(n))))
    return F.array_distinct(F.array_compact(known))


def selected(wanted: Column, detected: Column) -> Column:
    """``auto`` selects what was detected; an alias is resolved; what was not detected selects nothing."""
    name = F.coalesce(F.try_element_at(_map(ALIASES), F.lower(wanted)), F.lower(wanted))
    return F.when(F.lower(wanted) == "auto", detected).otherwise(F.array_intersect(F.array(name), detected))


def suite(profile: Column) -> Column:
    return F.try_element_at(_map(SUITES), profile)
