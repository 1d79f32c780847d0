"""Merging of findings that are one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import severity
from siltstone.operators.graph import components

#: Lines that two findings of one group may lie apart.
GAP = 1


def exact(rows: DataFrame) -> DataFrame:
    """One row for each file, line and rule: that of the highest severity, then of the least id, then of the least hash of its values."""
    order = [severity.rank(F.col("severity")).desc_nulls_last()] if "severity" in rows.columns else []
    ids = [F.col(c).asc_nulls_last() for c in ("id", "event_id") if c in rows.columns]
    first = Window.partitionBy("file", "start_line", "rule_id").orderBy(*order, *ids, F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def islands(rows: DataFrame, *keys: str, line: str = "start_line", gap: int = GAP) -> DataFrame:
    """Adds ``island``: within keys, runs of lines no more than ``gap`` apart, numbered from one."""
    w = Window.partitionBy(*keys).orderBy(line)
    fresh = F.when(F.col(line) - F.lag(line).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def groups(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Adds ``group``: findings linked by file, snippet hash, a common CWE and near lines, through others as well.

    ``key`` is a unique long. A finding without CWE is linked as if it had one of
    its own kind; findings of one CWE need no iteration, others meet by components.
    """
    each = rows.select(key, "file", "snippet_hash", "start_line", F.explode_outer("cwe").alias("one")).withColumn("one", F.coalesce("one", F.lit("")))
    placed = islands(each, "file", "snippet_hash", "one")
    first = F.min(key).over(Window.partitionBy("file", "snippet_hash", "one", "island"))
    links = placed.withColumn("first", first).select(F.col(key).alias("a"), F.col("first").alias("b")).distinct()
    shared = links.groupBy("a").count().filter("count > 1").limit(1).count()
    if shared:
        roots = components(links)
        found = links.select("a").distinct().join(roots, F.col("a") == F.col("node"), "left").select("a", F.coalesce("root", "a").alias("group"))
    else:
        found = links.select("a", F.col("b").alias("group"))
    return rows.join(found, rows[key] == found["a"]).drop("a")


def merged(rows: DataFrame, group: str = "group") -> DataFrame:
    """One row a group: highest severity, all tools, rules and CWEs, the longest dataflow (then the first finding)."""
    best = F.max_by(F.struct("file", "start_line", "event_id"), F.struct(severity.rank(F.col("severity")), F.col("n_steps"), -F.col("event_id")))
    return rows.groupBy(group).agg(
        F.max(severity.rank(F.col("severity"))).alias("rank"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cwe")))).alias("cwe"),
        F.max("n_steps").alias("n_steps"),
        F.count(F.lit(1)).alias("merged"),
        best.alias("best"),
    ).select("best.file", "best.start_line", severity.from_rank(F.col("rank")).alias("severity"), "tools", "rule_ids", "cwe", "n_steps", "merged")
