"""Findings over a stream of scans: when each was there, how often it came back and how long it took to fix.

The state of a finding is its open session and the late ones within the
watermark, kept by Spark with the checkpoint of the query, so a restart goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def episodes(findings: DataFrame, cadence_hours: int = 24, key: str = "fingerprint", at: str = "ts", late: str = "2 days") -> DataFrame:
    """(fingerprint, first_seen, last_seen, fixed_at, scans, days_open) of each time that a finding was there, once it is fixed.

    A scan is expected every ``cadence_hours``. A finding absent for one and a half of them is
    fixed, as of the scan after its last; when it returns, a new episode begins. In a stream an
    episode comes out once the watermark, ``late`` behind the newest event, has passed its end, and events
    later than that are dropped; a batch gives all episodes, open ones too. Repeated
    events of a scan are one. Rows without key or time are left out.
    """
    gap = f"{cadence_hours * 90} minutes"
    rows = findings.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("fingerprint"), F.col(at).alias("ts"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    own = rows.groupBy(F.session_window("ts", gap).alias("w"), "fingerprint").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    scans = 1 + F.round((F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) / (3600 * cadence_hours))
    fixed = F.col("last_seen") + F.make_dt_interval(hours=F.lit(cadence_hours))
    days = (F.unix_timestamp(fixed) - F.unix_timestamp("first_seen")) / 86400
    return own.select("fingerprint", "first_seen", "last_seen", fixed.alias("fixed_at"), scans.cast("long").alias("scans"), days.alias("days_open"))


def closed(found: DataFrame, newest) -> DataFrame:
    """The episodes of a batch that are fixed by the time of its newest scan: those a stream gives in the end."""
    return found.filter(F.col("fixed_at") <= F.lit(newest))


def time_to_fix(found: DataFrame) -> DataFrame:
    """(episodes, mttr_days) over fixed episodes, as of ``score.time_to_fix`` over the same scans."""
    return found.agg(F.count(F.lit(1)).alias("episodes"), F.round(F.avg("days_open"), 4).alias("mttr_days"))


def returns(found: DataFrame) -> DataFrame:
    """(fingerprint, episodes, first_seen, last_fixed, days_open): each finding over its fixed episodes, to read beside the stream."""
    return found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("episodes"), F.min("first_seen").alias("first_seen"), F.max("fixed_at").alias("last_fixed"), F.sum("days_open").alias("days_open"))
