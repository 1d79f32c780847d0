"""Episodes of findings in a stream: late and repeated events, a restart, and the batch."""

import random
from datetime import datetime, timedelta

from siltstone.operators import score
from siltstone.streaming import episodes

BEGIN = datetime(2024, 1, 1)
SCHEMA = "fingerprint string, ts timestamp"


def history(days=40, keys=25, seed=3):
    """{day: keys of its scan}; a last key is in every scan."""
    rng = random.Random(seed)
    out = {d: set() for d in range(days)}
    for k in range(keys):
        on = False
        for d in range(days):
            on = rng.random() < (0.7 if on else 0.15)
            if on:
                out[d].add(f"k{k}")
    for d in out:
        out[d].add("always")
    return out


def plain(scans):
    """(key, first day, last day, day of the scan without it) of episodes that ended."""
    out = set()
    for k in set().union(*scans.values()):
        first = None
        for d in range(len(scans)):
            if k in scans[d]:
                first = d if first is None else first
            elif first is not None:
                out.add((k, first, d - 1, d))
                first = None
    return out


def rows(scans, days, twice=lambda d, k: False):
    return [(k, BEGIN + timedelta(days=d, minutes=m)) for d in days for k in sorted(scans[d]) for m in ((0, 0) if twice(d, k) else (0,))]


def as_days(found):
    day = lambda t: (t - BEGIN).days
    return sorted((r["fingerprint"], day(r["first_seen"]), day(r["last_seen"]), day(r["fixed_at"])) for r in found.collect())


def test_stream_with_late_and_repeated_events_and_a_restart_equals_the_batch(spark, tmp_path):
    scans = history()
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    # Every third key of a scan comes a day late; some events come twice.
    late = lambda d: [r for r in rows(scans, [d], lambda d, k: hash_of(d, k) % 4 == 0) if hash_of(d, r[0]) % 3 == 0]
    soon = lambda d: [r for r in rows(scans, [d], lambda d, k: hash_of(d, k) % 4 == 0) if hash_of(d, r[0]) % 3 != 0]
    hash_of = lambda d, k: sum(map(ord, k)) * 31 + d * 7

    def run(days):
        for d in days:
            part = (soon(d) if d in scans else []) + (late(d - 1) if d - 1 in scans else [])
            # Beyond the history the stream goes on with one other finding, which moves the watermark.
            part = part or [("mark", BEGIN + timedelta(days=d))]
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 5).parquet(source)
        started = episodes.episodes(read).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        started.awaitTermination()

    run(range(0, 20))
    early = as_days(spark.read.parquet(sink))
    assert early and set(early) <= plain(scans)
    # A new query from the same checkpoint goes on with the open episodes.
    run(range(20, 46))
    found = spark.read.parquet(sink).filter("fingerprint not in ('always', 'mark') and fixed_at < timestamp '2024-02-10'")
    assert as_days(found) == sorted(plain(scans))
    facts = spark.createDataFrame([(BEGIN.date() + timedelta(days=d), k) for d in scans for k in scans[d]], "scan_date date, key string")
    assert episodes.time_to_fix(found).collect() == score.time_to_fix(facts).collect()


def test_batch_has_the_same_episodes_and_open_ones(spark):
    scans = history(seed=8)
    every = episodes.episodes(spark.createDataFrame(rows(scans, scans, lambda d, k: d % 2 == 0), SCHEMA))
    done = episodes.closed(every, BEGIN + timedelta(days=len(scans) - 1))
    assert as_days(done) == sorted(plain(scans))
    assert {r["fingerprint"]: r["scans"] for r in every.collect()}["always"] == len(scans)
    again = {r["fingerprint"]: r["episodes"] for r in episodes.returns(done).collect()}
    assert max(again.values()) > 1 and again == {k: sum(p[0] == k for p in plain(scans)) for k in again}


def test_rows_without_key_or_time_and_empty_tables(spark):
    assert episodes.episodes(spark.createDataFrame([(None, BEGIN), ("a", None)], SCHEMA)).isEmpty()
    assert episodes.time_to_fix(episodes.episodes(spark.createDataFrame([], SCHEMA))).first()["episodes"] == 0
    one = episodes.episodes(spark.createDataFrame([("a", BEGIN)], SCHEMA)).first()
    assert one["days_open"] == 1.0 and one["scans"] == 1


def test_other_cadence(spark):
    at = [BEGIN + timedelta(hours=h) for h in (0, 6, 12, 24, 30)]
    found = episodes.episodes(spark.createDataFrame([("a", t) for t in at], SCHEMA), cadence_hours=6).orderBy("first_seen").collect()
    assert [(r["scans"], r["days_open"]) for r in found] == [(3, 0.75), (2, 0.5)]
