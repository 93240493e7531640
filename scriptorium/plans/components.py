"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so neither a node with very
many edges nor a large component has to fit into one task: the minimum is combined
before the shuffle, and the join has plain shuffles on both sides, whose large
partitions adaptive execution splits. The number of rounds grows with the logarithm
of the number of nodes. Each round is written to the workspace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.plans.workspace import Workspace


def _with_min(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    joined = _with_min(down)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, ws: Workspace, left: str = "u", right: str = "v") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is its least node.

    Edges that are loops, repeated or have a null end change nothing: a loop alone
    gives no row. An empty edge table gives no rows.
    """
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    now, seen = ws.save(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(state) == seen or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        seen, before = tuple(state), now
        now = ws.save(_small_star(_large_star(now)), "stars")
        ws.drop(before)
