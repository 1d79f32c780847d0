"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the budget's threshold lies in one
bucket, and only that bucket is refined by further bits of the hash. What is taken
is then a comparison of each row's hash with its source's thresholds: no data are
sorted, and a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, discard, hash60, settle

#: Weights of the sources in order of code points, repeating; share of all sizes to take; times a source may be taken at most.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Hash bits, and those below the bucket at each level: 16,384 buckets a source and level, single hashes at the last.
BITS, LEVELS = 60, (46, 32, 18, 4, 0)
#: Budget rounds: the first takes rows while they fit, further ones fill the gap with rows that still fit.
ROUNDS = 3
#: Sources up to which their table of thresholds is broadcast; beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def measured(docs: DataFrame, text: str, source: str, key: str, *carried: Column) -> DataFrame:
    """(carried.., source, sk, size, h): size in words (null text: 0), h from key and text, sk a source key without nulls."""
    name = F.col(source).cast("string")
    return docs.select(
        *carried,
        name.alias("source"),
        F.coalesce(F.concat(F.lit("s"), name), F.lit("n")).alias("sk"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        hash60(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))).alias("h"),
    )


def targets(base: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, sk, source_size, target, copies, budget) of each source.

    A source's share of ``share`` times all sizes goes by its weight; where this is
    over ``cap`` times its size it stops there and the rest share the excess by
    weight. With sources by rising size per weight, those that stop come first, so
    one ordered pass finds where that ends. ``copies`` is how often all rows are
    taken, ``budget`` the words beyond. One row per source is ordered here, never
    the data.
    """
    per = base.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("bigint")
    every = Window.partitionBy()
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    stepped = (
        per.withColumn("weight", weight)
        .withColumn("whole", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("held", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    top = F.lit(cap) * F.col("source_size")
    # With all before it stopped, does its part of what is left exceed its cap?
    stops = (F.col("whole") - F.col("held")) * F.col("weight") > top * F.col("rest")
    first = F.min(F.when(~stops, F.struct(F.col("source_size") / F.col("weight"), "held", "rest"))).over(every)
    part = (F.col("whole") - F.col("first.held")) * F.col("weight") / F.col("first.rest")
    target = F.when(stops | F.col("first").isNull(), top.cast("double")).otherwise(F.least(part, top.cast("double")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    out = stepped.withColumn("first", first).select("source", "sk", "source_size", target.alias("target"))
    return out.withColumn("copies", copies).withColumn("budget", F.floor("target").cast("bigint") - F.col("copies") * F.col("source_size"))


def _threshold(rows: DataFrame, budget: DataFrame, small) -> tuple[DataFrame, list[DataFrame]]:
    """(sk, t, left), and the settled tables behind it: t is the least hash at which a source's sizes, by rising hash, exceed its budget.

    rows: (sk, size, h); budget: (sk, budget). Without such a hash t is 2**60; left
    is what remains of the budget below t. A source without rows is missing.
    """
    done, used = None, []
    for shift in LEVELS:
        run = F.sum("size").over(Window.partitionBy("sk").orderBy("bucket"))
        hist = rows.groupBy("sk", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        found = (
            hist.join(small(budget), "sk")
            .withColumn("run", run)
            .groupBy("sk", "budget")
            .agg(
                F.min(F.when(F.col("run") > F.col("budget"), F.col("bucket"))).alias("bucket"),
                F.max(F.when(F.col("run") <= F.col("budget"), F.col("run"))).alias("below"),
            )
            .select("sk", "bucket", (F.col("budget") - F.coalesce("below", F.lit(0))).alias("left"))
        )
        found = settle(found, "mix-level", few=True)
        used.append(found)
        ended = found.filter("bucket is null").select("sk", F.lit(1 << BITS).cast("bigint").alias("t"), "left")
        done = ended if done is None else done.unionByName(ended)
        found = found.filter("bucket is not null")
        budget = found.select("sk", F.col("left").alias("budget"))
        if shift:
            edge = found.select("sk", "bucket")
            rows = rows.withColumn("bucket", F.shiftright("h", shift)).join(small(edge), ["sk", "bucket"], "left_semi").drop("bucket")
            if len(used) == 1:
                # One bucket of each source is left: further levels read no more than that.
                rows = settle(rows, "mix-edge", few=True)
                used.append(rows)
    return done.unionByName(found.select("sk", F.col("bucket").alias("t"), "left")), used


def plan(base: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Each source's target and thresholds t1.. with size limits g1..: see ``extra``."""
    base = base.select("source", "sk", "size", "h")
    found = settle(targets(base, weights, share, cap), "mix-targets", few=True)
    small = F.broadcast if found.count() <= BROADCAST_SOURCES else (lambda df: df)
    for k in range(1, ROUNDS + 1):
        left = "budget" if k == 1 else f"g{k - 1}"
        rows = base.select("sk", "size", "h")
        if k > 1:
            rows = rows.join(small(found), "sk").filter(~extra(k - 1) & (F.col("size") <= F.col(left))).select("sk", "size", "h")
        t, used = _threshold(rows, found.select("sk", F.col(left).alias("budget")), small)
        after = settle(
            found.join(t, "sk", "left").withColumn(f"t{k}", F.coalesce("t", F.lit(0))).withColumn(f"g{k}", F.coalesce("left", F.col(left))).drop("t", "left"),
            "mix-plan",
            few=True,
        )
        discard(found, *used)
        found = after
    return small(found)


def extra(rounds: int = ROUNDS) -> Column:
    """Does a row belong to the part of its source that is taken once more? Rows without words never do."""
    out = F.col("h") < F.col("t1")
    for k in range(2, rounds + 1):
        out = out | ((F.col("size") <= F.col(f"g{k - 1}")) & (F.col("h") < F.col(f"t{k}")))
    return out & (F.col("size") > 0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, *, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """How often each row is taken: (key, size, source_size, target, taken, copies).

    Nulls: a null text has size 0, a null source is a source of its own, last in
    order; a null key is as good as any. Rows equal in key and text share a hash and
    are taken together. An empty table gives none.
    """
    base = settle(measured(docs, text, source, key, F.col(key).alias("id")), "mix-sizes")
    copies = (F.col("copies") + extra().cast("bigint")).alias("copies")
    out = base.join(plan(base, weights, share, cap).drop("source"), "sk").select(F.col("id").alias(key), "size", "source_size", "target", copies)
    return out.select(key, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, *, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of ``docs`` with their columns, each as often as it is taken.

    Rows without words are taken as often as all rows of their source, never once more.
    """
    base = settle(measured(docs, text, source, key), "mix-sizes")
    rows = measured(docs, text, source, key, F.struct("*").alias("row"))
    copies = (F.col("copies") + extra().cast("bigint")).cast("int")
    taken = rows.join(plan(base, weights, share, cap).drop("source"), "sk")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")


SQL = r"""
WITH b AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM b GROUP BY source),
w AS (SELECT *, [5, 2, 1][k % 3 + 1]::BIGINT AS weight, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS whole FROM s),
o AS (SELECT *, coalesce(sum(source_size) OVER u, 0)::BIGINT * 2 AS held,
        (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER u, 0)::BIGINT AS rest
      FROM w WINDOW u AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (whole - held) * weight > (2 * source_size * rest)::DOUBLE AS stops FROM o),
f AS (SELECT held AS fheld, rest AS frest FROM p WHERE NOT stops ORDER BY source_size::DOUBLE / weight, held, rest LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN stops OR frest IS NULL THEN (2 * source_size)::DOUBLE
        ELSE least((whole - fheld) * weight / frest, (2 * source_size)::DOUBLE) END AS target FROM p LEFT JOIN f ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
r0 AS (SELECT b.doc_id, b.source, b.size, b.h, g.source_size, g.target, g.copies, floor(g.target)::BIGINT - g.copies * g.source_size AS budget
       FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
r1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) <= budget AS x1 FROM r0),
l1 AS (SELECT *, budget - coalesce(sum(size) FILTER (WHERE x1) OVER (PARTITION BY source), 0) AS g1 FROM r1),
r2 AS (SELECT *, NOT x1 AND size <= g1 AND sum(CASE WHEN NOT x1 AND size <= g1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= g1 AS x2 FROM l1),
l2 AS (SELECT *, g1 - coalesce(sum(size) FILTER (WHERE x2) OVER (PARTITION BY source), 0) AS g2 FROM r2),
r3 AS (SELECT *, NOT x1 AND NOT x2 AND size <= g2 AND sum(CASE WHEN NOT x1 AND NOT x2 AND size <= g2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= g2 AS x3 FROM l2)
SELECT doc_id, size, source_size, target, copies + ((x1 OR x2 OR x3) AND size > 0)::BIGINT AS copies, size * (copies + ((x1 OR x2 OR x3) AND size > 0)::BIGINT) AS taken FROM r3
"""
