"""Connected components of links, without a link, component or node ever reaching the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the smallest node reachable. Rows with u = v or a null are ignored, repeated ones count once.

    Alternating large-star and small-star rounds: each hangs a node's neighbours on the smallest
    of them. Minima are aggregated before the shuffle and come back by a join, so a node with a
    great many neighbours is neither collected nor sorted in one place. Rounds grow with the
    logarithm of the number of nodes; each one is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u hangs on the least of u and its neighbours.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours hang on the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
