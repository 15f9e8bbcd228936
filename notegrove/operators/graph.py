"""Expansion of seed notes over a typed graph, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relation weights.
WEIGHTS = {"contradicts": 1.0, "extends": 0.9, "depends_on": 0.9, "supports": 0.8, "exemplifies": 0.7, "related": 0.5}


def relation_weight(relation: Column, weights: dict[str, float] | None = None) -> Column:
    """Unknown types weigh as ``related``."""
    w = WEIGHTS if weights is None else weights
    table = F.create_map(*[F.lit(x) for kv in w.items() for x in kv])
    return F.coalesce(table[relation], F.lit(w.get("related", 0.5)))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (source, target, relation_type); two equi-joins instead of one with OR."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation_type")
    return edges.select("source", "target", "relation_type").unionByName(back)


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 1, decay: float = 0.5, most: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, weight, hop, via_from, via_relation): the best neighbours of each query's seeds
    (query_id, id, weight). A hop multiplies the anchor's weight, the relation's and decay^(hop - 1); a node is
    expanded once, at the hop that reaches it first; the best weight over all hops counts, the earlier hop on ties.
    Hops are unrolled joins."""
    both = undirected(edges).select(F.col("source").alias("anchor"), F.col("target").alias("other"), F.col("relation_type").alias("rel"), relation_weight(F.col("relation_type"), weights).alias("rw"))
    taken = seeds.select("query_id", "id").distinct()
    frontier, found = seeds.groupBy("query_id", "id").agg(F.max("weight").alias("w")), None
    for hop in range(1, hops + 1):
        cand = frontier.join(both, frontier["id"] == both["anchor"]).select("query_id", F.col("other").alias("id"), (F.col("w") * F.col("rw") * decay ** (hop - 1)).alias("weight"), F.lit(hop).alias("hop"), F.col("anchor").alias("via_from"), F.col("rel").alias("via_relation"))
        cand = cand.join(seeds.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
        order = Window.partitionBy("query_id", "id").orderBy(F.round("weight", 9).desc(), "via_from", "via_relation")
        best = cand.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
        found = best if found is None else found.unionByName(best)
        if hop < hops:
            frontier = best.join(taken, ["query_id", "id"], "left_anti").select("query_id", "id", F.col("weight").alias("w"))
            taken = taken.unionByName(frontier.select("query_id", "id"))
    order = Window.partitionBy("query_id", "id").orderBy(F.round("weight", 9).desc(), "hop", "via_from", "via_relation")
    best = found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    top = Window.partitionBy("query_id").orderBy(F.round("weight", 9).desc(), "hop", "id")
    return best.withColumn("r", F.row_number().over(top)).where(F.col("r") <= most).drop("r")


def new_pairs(candidates: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate links (source, target) without self-loops whose unordered pair has no edge and whose target exists."""
    pair = lambda d: d.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"))
    fresh = candidates.where("source <> target").withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    fresh = fresh.join(pair(edges).distinct(), ["lo", "hi"], "left_anti").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return fresh.groupBy("lo", "hi").agg(F.min(F.struct("source", "target")).alias("s")).select("s.source", "s.target")
