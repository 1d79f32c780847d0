"""Content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u0001"


def _digest(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def normalized(snippet: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"\s+", " "))


def fingerprint(file: Column, rule_id: Column, cwe: Column, snippet: Column, start_line: Column, end_line: Column) -> Column:
    """Stable as lines move: file, rule, sorted CWEs and the snippet with runs of white space as one blank.

    Without a snippet the lines stand in for it. The choice of inputs is ours.
    """
    body = normalized(snippet)
    lines = F.concat_ws(":", F.lit("lines"), start_line, end_line)
    return _digest(F.lit("v2"), file, rule_id, F.array_join(F.array_sort(F.coalesce(cwe, F.array().cast("array<string>"))), ","), F.when(body != "", body).otherwise(lines))


def fingerprint_v1(file: Column, start_line: Column, rule_id: Column) -> Column:
    return _digest(F.lit("v1"), file, start_line, rule_id)


def branch(fingerprint: Column) -> Column:
    """Name of a branch that fixes a finding."""
    return F.concat(F.lit("sast-fix/"), F.substring(fingerprint, 1, 12))
