"""Registered queries over the driver's tables, and their SQL.

Findings come from ``sources.tables``: synthetic, but by the same expressions in
both engines. In the SQL, ``f`` are these findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False):
    """Register a query, with SQL over f (raw: over the tables alone)."""

    def register(function):
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql if raw else tables.duck(sql)
        return function

    return register


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.findings(spark, sf_dir)


def as_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


from siltstone.plans import analyses, deep, governance, graphs, ingest, measures, stored  # noqa: E402,F401
