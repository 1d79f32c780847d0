"""Properties that hold whatever the data, and of the plans."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import baseline, dedupe, filters, score, triage
from siltstone.plans import catalogue, governance, measures
from siltstone.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return tables.findings(spark, SF).cache()


def test_buckets_sum_to_all(found):
    assert triage.buckets(found).agg(F.sum("n")).first()[0] == found.count()


def test_exact_dedupe_is_idempotent(found):
    once = dedupe.exact(found)
    assert dedupe.exact(once).count() == once.count() <= found.count()


def test_merging_loses_no_finding(spark):
    hashed = measures._hashed(spark, SF).withColumn("cwe", F.array("cwe"))
    merged = dedupe.merged(dedupe.groups(hashed))
    assert merged.agg(F.sum("merged")).first()[0] == hashed.count()


def test_positives_are_split_in_found_and_missed(spark):
    rows = measures._outcomes(spark, SF)
    r = score.counts(rows).first()
    assert r["tp"] + r["fn"] == rows.filter("real").count() and sum(r) == rows.count()


def test_delta_is_new_less_fixed(found):
    rows = score.scan_deltas(found.select("scan_date", F.col("coarse").alias("key"))).filter("total_delta is not null").collect()
    assert rows and all(r["total_delta"] == r["new_count"] - r["fixed_count"] for r in rows)


def test_diff_is_symmetric(spark):
    rows = governance.printed(spark, SF)
    a, b = rows.filter("scan_date = date '2024-01-10'"), rows.filter("scan_date = date '2024-01-11'")
    there = {r["fingerprint"]: r["change"] for r in baseline.diff(a, b).collect()}
    back = {r["fingerprint"]: r["change"] for r in baseline.diff(b, a).collect()}
    other = {"added": "removed", "removed": "added", "unchanged": "unchanged"}
    assert {k: other[v] for k, v in there.items()} == back


def test_filters_never_add(found):
    assert filters.fast(found).count() <= found.count() == filters.soft(found).count()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.integers(1, 5)), max_size=25))
def test_trend_counts_of_any_history(spark, facts):
    df = spark.createDataFrame([(f"2024-01-{d:02d}", k) for k, d in facts], "scan_date string, key string").withColumn("scan_date", F.to_date("scan_date"))
    days = sorted({d for _, d in facts})
    seen = {d: {k for k, e in facts if e == d} for d in days}
    rows = {r["scan_date"].day: r for r in score.scan_deltas(df).collect()}
    assert sorted(rows) == days
    for before, day in zip([None, *days], days):
        last = seen.get(before, set())
        assert (rows[day]["total"], rows[day]["new_count"], rows[day]["fixed_count"]) == (len(seen[day]), len(seen[day] - last), len(last - seen[day]))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_plans_stay_native(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|InPandas|InArrow|PythonUDF|CartesianProduct", plan)
