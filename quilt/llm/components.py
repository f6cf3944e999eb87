"""Connected components of a graph of long node ids, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quilt.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
    moved = edges.join(least, F.col("a") == F.col("w")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b) but the least of each component.

    component is the least node reachable. Self-links and repeated links are
    harmless, no links give no rows. Each round's links are written to the
    shared folder and those of the round before are deleted; rounds (some
    log n of them) end when one changes nothing. A hub's links meet a single
    row in the join, so adaptive execution splits them at will.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before, mark = None, None
    while True:
        # Equal counts and hash sums mean equal link sets; decimals keep the sum from overflowing.
        seen = Observation()
        now = common.materialise(now.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
        if before is not None:
            common.discard(before)
        found = (seen.get["n"], seen.get["h"])
        if not found[0] or found == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, mark = now, found
        now = _small_star(_large_star(now))
