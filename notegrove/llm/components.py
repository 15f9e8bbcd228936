"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm.common import stored

MAX_ROUNDS = 40


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; links has long columns a and b, in any
    direction. component: the smallest node of its component. Each round is one aggregation and one join,
    so a node with very many links is a skewed join at most; rounds are written to the shared folder.
    A round takes a star's leaves to its centre, so their number grows with the logarithm of a
    component's diameter."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u meets the smallest of its surroundings
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours meet the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = stored(small)
        moved = new.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(new, ["u", "v"], "left_anti").limit(1).count()
        edges = new
        if not moved:
            break
    else:
        raise RuntimeError("the components did not settle")
    leaf = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaf.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
