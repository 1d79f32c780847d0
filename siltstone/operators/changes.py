"""Unified diffs as changed files and line ranges, and findings on changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bin of the interval join.
WIDTH = 256

_RANGES = "array<struct<first:int,last:int>>"


def _added(hunk: Column) -> Column:
    """Ranges of added lines of a hunk, by their numbers in the new file: a fold over its lines."""
    lines = F.split(hunk, "\n")
    start = F.regexp_extract(F.get(lines, 0), r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int")
    none = F.lit(None).cast("int")
    begin = F.struct(start.alias("at"), none.alias("first"), F.array().cast(_RANGES).alias("done"))
    closed = lambda s: F.when(s["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last")))))

    def step(s: Column, line: Column) -> Column:
        sign = F.substring(line, 1, 1)
        plus = F.struct((s["at"] + 1).alias("at"), F.coalesce(s["first"], s["at"]).alias("first"), s["done"].alias("done"))
        same = F.struct((s["at"] + 1).alias("at"), none.alias("first"), closed(s).alias("done"))
        # Removed lines, and the mark of a missing line end, are no lines of the new file.
        return F.when(sign == "+", plus).when(sign.isin("-", "\\"), s).otherwise(same)

    return F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), begin, step, closed)


def changes(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """One row for each file of each diff: the diff's other columns, file, previous, kind and ranges (first, last) of added lines.

    kind is added, deleted, renamed, copied or modified; a deleted file goes by its old name, and
    only renamed and copied ones have a previous one. Diffs are those of git, or plain ones with
    ``---`` and ``+++`` lines; names in quotes keep their escapes. What stands before the
    first file is passed over. No shuffle: files and hunks are pieces of the text. A null or empty diff has no rows.
    """
    kept = [c for c in diffs.columns if c not in (text, "file", "previous", "kind", "ranges")]
    body = F.regexp_replace(F.col(text), "\r\n", "\n")
    pieces = F.when(body.rlike(r"(?m)^diff --git "), F.split(body, r"(?m)(?=^diff --git )")).otherwise(F.split(body, r"(?m)(?=^--- [^\n]*\n\+\+\+ )"))
    files = diffs.select(*kept, F.explode(pieces).alias("_piece")).filter(F.col("_piece").rlike(r"^(diff --git |--- )"))
    hunks = files.select(*kept, F.split("_piece", r"\n(?=@@ -)").alias("_hunks")).withColumn("_head", F.get("_hunks", 0))
    said = lambda pattern: F.nullif(F.regexp_extract("_head", pattern, 1), F.lit(""))
    old = F.coalesce(said(r'(?m)^(?:rename|copy) from (.+)$'), said(r'(?m)^--- "?(?:a/)?([^\t\n"]+)'), said(r'^diff --git "?a/(.+?)"? "?b/'))
    new = F.coalesce(said(r'(?m)^(?:rename|copy) to (.+)$'), said(r'(?m)^\+\+\+ "?(?:b/)?([^\t\n"]+)'), said(r'^diff --git .* "?b/([^\n"]+)'))
    has = lambda pattern: F.col("_head").rlike(pattern)
    kind = (
        F.when(has(r"(?m)^new file|^--- /dev/null"), "added")
        .when(has(r"(?m)^deleted file|^\+\+\+ /dev/null"), "deleted")
        .when(has(r"(?m)^rename from "), "renamed")
        .when(has(r"(?m)^copy from "), "copied")
        .otherwise("modified")
    )
    ranges = F.flatten(F.transform(F.slice("_hunks", 2, F.greatest(F.size("_hunks") - 1, F.lit(0))), _added))
    return hunks.withColumn("kind", kind).select(
        *kept,
        F.when(F.col("kind") == "deleted", old).otherwise(new).alias("file"),
        F.when(F.col("kind").isin("renamed", "copied"), old).alias("previous"),
        "kind",
        ranges.alias("ranges"),
    )


def changed_files(changed: DataFrame) -> DataFrame:
    """(file,) of what a change leaves in place, each once."""
    return changed.filter("kind != 'deleted' and file is not null").select("file").distinct()


def changed_lines(changed: DataFrame) -> DataFrame:
    """(file, first, last) of each range of added lines."""
    return changed.filter("kind != 'deleted'").select("file", F.explode("ranges").alias("r")).select("file", "r.first", "r.last")


def overlapping(left: DataFrame, right: DataFrame, key: str = "file", width: int = WIDTH) -> DataFrame:
    """Pairs of rows whose lines [first, last] overlap, with an equal key: columns of ``left``, and r_first, r_last.

    Both sides are cut into bins of ``width`` lines and joined on (key, bin) by equality; a pair that
    shares several bins is one in the bin where the later of both starts.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("_bin")
    whole = F.col("first").isNotNull() & (F.col("last") >= F.col("first"))
    a = left.filter(whole).select("*", bins())
    b = right.filter(whole).select(key, "first", "last", bins()).toDF(key, "r_first", "r_last", "_bin")
    both = a.join(b, [key, "_bin"]).filter((F.col("first") <= F.col("r_last")) & (F.col("r_first") <= F.col("last")))
    return both.filter(F.col("_bin") == F.floor(F.greatest("first", "r_first") / width)).drop("_bin")


def on_changed_lines(findings: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Findings (file, start_line, end_line where there is one) of which a line was added; ``key`` names a finding."""
    last = F.coalesce("end_line", "start_line") if "end_line" in findings.columns else F.col("start_line")
    spans = findings.select(F.col(key).alias("_key"), "file", F.col("start_line").alias("first"), F.greatest(last, "start_line").alias("last"))
    ranges = changed_lines(changed).distinct()
    hit = overlapping(spans, ranges).select("_key").distinct()
    return findings.join(hit, F.col(key) == F.col("_key"), "left_semi")
