"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.session import dropped, stored


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v: bigint): root is the least node of its component.

    Each round is written to the shared folder, so lineage stays short and lost executors cost one round; only
    the result's table stays (a stored one). Rounds grow with the logarithm of the longest path.
    Raises RuntimeError if `rounds` do not suffice. No edges give an empty table.
    """
    edges = stored(_distinct(edges.select("u", "v")), "edges")
    seen = None
    for _ in range(rounds):
        before = edges
        edges = stored(_star(edges), "edges")
        dropped(before)
        # exclusive ors of two hashes of each edge: the same for the same (distinct) edges in any order
        state = edges.agg(F.count("*"), *(F.bit_xor(F.xxhash64("u", "v", F.lit(k))) for k in (1, 2))).first()
        if state == seen:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
            dropped(edges)
            return out
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Least neighbours are aggregated and joined back, so a node with many
    neighbours combines before the shuffle and the join may split it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
    joined = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
    return _distinct(joined)
