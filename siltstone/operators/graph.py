"""Connected components by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import discard, settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes with links: root is the least node that links lead to.

    First each node keeps its link to its least neighbour p only, and links its
    other neighbours to p in its place, which leaves about one link a node. Then each
    round takes the least root among neighbours, then the root's root, until none
    changes; only a count comes to the driver.
    """
    given = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    least = given.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("p"))
    lean = given.join(least, F.col("u") == F.col("w")).select(F.when(F.col("v") == F.col("p"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("p").alias("v"))
    both = lean.filter("u != v")
    edges = settle(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    last = roots = settle(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")), "roots")
    while True:
        near = edges.join(roots, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        hop = roots.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        over = roots.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        jump = hop.join(over, F.col("root") == F.col("at"), "left").select("node", "old", F.least("root", F.coalesce("beyond", "root")).alias("root"))
        after = settle(jump, "roots")
        moved = after.filter("root < old").limit(1).count()
        discard(last)
        last, roots = after, after.select("node", "root")
        if not moved:
            discard(edges)
            roots._scratch = last._scratch
            return roots
