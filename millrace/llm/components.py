"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step links nodes to the least node they know of: the large step a node's
larger neighbours, the small step the node and its smaller ones.  The edges
shrink to stars whose centres are the components' least nodes.  Only the least
neighbour of a node is aggregated, before the shuffle, so a node with very many
edges is no group in any task's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        made = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return made.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's least; others are their own root.

    Self loops and repeated edges don't matter; no edges give no rows.  The steps
    are repeated until they change nothing.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") > F.col("v")).distinct())
    seal = None
    while True:
        last = seal
        seal = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seal == last or seal[0] == 0:
            break
        now = cut(_star(_star(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
