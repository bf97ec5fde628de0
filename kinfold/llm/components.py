"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node that can be reached.

    Alternates large-star and small-star steps, each one grouping of minima (combined before the shuffle)
    and one join, until a grouping finds the edges to be stars (a table of stars costs no round); the number of
    rounds grows with the logarithm of the longest path.
    A node with very many neighbours is a skewed join key, which adaptive execution splits; no node's
    neighbours meet in one place. Null ends and loops are ignored. Each round is cut to the checkpoint folder.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = cut(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stars: whoever has a lesser neighbour has no other
        around = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        if around.where("m < u and x > m").isEmpty():
            break
        # large-star: every neighbour above a node links to the least one around it; one row for each edge
        least = around.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v")
        # small-star: the lower neighbours of a node and the node link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.where("u > v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
