"""The gate over a stream of findings: an extension, as the batch operators know no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import severity


def first_seen(findings: DataFrame, key: str = "fingerprint", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each fingerprint once within the watermark."""
    return findings.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_gate(findings: DataFrame, fail_on: str = "high", window: str = "1 day", at: str = "ts", late: str = "1 day") -> DataFrame:
    """(start, end, total, blocking_count, passed) of each window of event time; late findings within the watermark count."""
    blocks = severity.at_least(F.col("severity"), fail_on) & ~F.col("is_suppressed")
    rows = findings.withWatermark(at, late).groupBy(F.window(at, window).alias("w"))
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(blocks).alias("blocking_count"))
    return out.select("w.start", "w.end", "total", "blocking_count", (F.col("blocking_count") == 0).alias("passed"))
