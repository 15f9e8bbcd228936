"""Topic maps that follow their clusters: which map a cluster goes on with, and what becomes of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrove.session import stored


def overlaps(clusters: DataFrame, maps: DataFrame, least: float = 0.3) -> DataFrame:
    """(cluster, map, shared, cluster_size, map_size) of clusters (cluster, id) and maps (map, id) that share the given part of
    the smaller of them. Repeated members count once; rows with a null are no members."""
    c = clusters.select("cluster", "id").where("cluster is not null and id is not null").distinct()
    m = maps.select("map", "id").where("map is not null and id is not null").distinct()
    shared = c.join(m, "id").groupBy("cluster", "map").agg(F.count("*").alias("shared"))
    sized = shared.join(c.groupBy("cluster").agg(F.count("*").alias("cluster_size")), "cluster").join(m.groupBy("map").agg(F.count("*").alias("map_size")), "map")
    return sized.where(F.col("shared") >= least * F.least("cluster_size", "map_size"))


def _certain(edges: DataFrame) -> DataFrame:
    """Edges that some best matching holds: as heavy as the next edge of its cluster and the next of its map together."""
    def beside(side: str) -> DataFrame:
        other = "map" if side == "cluster" else "cluster"
        two = edges.withColumn("r", F.row_number().over(Window.partitionBy(side).orderBy(F.col("shared").desc(), other))).where("r <= 2")
        return two.groupBy(side).agg(F.max(F.when(F.col("r") == 1, F.col(other))).alias(f"{side}_first"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("shared"))), F.lit(0)).alias(f"{side}_second"), F.max("shared").alias(f"{side}_best"))

    def rest(side: str, other: str):
        return F.when(F.col(other) == F.col(f"{side}_first"), F.col(f"{side}_second")).otherwise(F.col(f"{side}_best"))

    both = edges.join(beside("cluster"), "cluster").join(beside("map"), "map")
    sure = both.where(F.col("shared") >= rest("cluster", "map") + rest("map", "cluster")).select("cluster", "map", "shared")
    order = [F.col("shared").desc(), F.col("cluster"), F.col("map")]
    first = sure.withColumn("c", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).withColumn("m", F.row_number().over(Window.partitionBy("map").orderBy(*order)))
    return first.where("c = 1 and m = 1").select("cluster", "map", "shared")


def _auction(edges: DataFrame) -> DataFrame:
    """A matching of the most weight by rounds of bids. With weights times (n + 1) and steps of one, n clusters lose less than one
    unit of weight together, so the result is exact; a cluster leaves when no map is worth its price. Each round is one plan."""
    n = edges.select("cluster").distinct().count()
    worth = stored(edges.select("cluster", "map", (F.col("shared") * (n + 1)).alias("worth")))
    state = edges.select("map").distinct().select("map", F.lit(0).cast("long").alias("price"), F.lit(None).cast(edges.schema["cluster"].dataType).alias("owner"))
    while True:
        free = worth.join(state.where("owner is not null").select(F.col("owner").alias("cluster")), "cluster", "left_anti")
        gain = free.join(state.select("map", "price"), "map").withColumn("gain", F.col("worth") - F.col("price"))
        w = Window.partitionBy("cluster").orderBy(F.col("gain").desc(), "map")
        two = gain.withColumn("r", F.row_number().over(w)).withColumn("next", F.greatest(F.lead("gain", 1, 0).over(w), F.lit(0)))
        bids = two.where("r = 1 and gain > 0").select("map", "cluster", (F.col("price") + F.col("gain") - F.col("next") + 1).alias("bid"))
        best = bids.groupBy("map").agg(F.max_by(F.struct("bid", "cluster"), F.struct(F.col("bid"), -F.xxhash64("cluster"))).alias("b"))
        after = stored(state.join(best, "map", "left").select("map", F.coalesce("b.bid", "price").alias("price"), F.coalesce("b.cluster", "owner").alias("owner"), F.col("b").isNotNull().alias("sold")))
        state = after.drop("sold")
        if after.where("sold").isEmpty():
            won = state.where("owner is not null").select(F.col("owner").alias("cluster"), "map")
            return won.join(edges, ["cluster", "map"]).select("cluster", "map", "shared")


def matched(edges: DataFrame) -> DataFrame:
    """(cluster, map, shared): a matching with the largest sum of shared members. Edges that must be in one are taken first,
    round by round, which settles all but entangled clusters; those bid."""
    left, out = stored(edges.select("cluster", "map", F.col("shared").cast("long").alias("shared"))), []
    while not left.isEmpty():
        sure = stored(_certain(left))
        if sure.isEmpty():
            out.append(_auction(left))
            break
        out.append(sure)
        left = stored(left.join(sure.select("cluster"), "cluster", "left_anti").join(sure.select("map"), "map", "left_anti"))
    got = edges.limit(0).select("cluster", "map", F.col("shared").cast("long").alias("shared"))
    for part in out:
        got = got.unionByName(part)
    return got


def evolution(clusters: DataFrame, maps: DataFrame, least: float = 0.3, most: float = 0.5) -> DataFrame:
    """(cluster, map, event, shared) of clusters (cluster, id) against maps (map, id):

    * continue: the cluster goes on with the map that the best matching gives it;
    * split: a cluster without map, more than ``most`` of whose members one map holds; it gets a map beside that one;
    * new: any other cluster without map (map is null);
    * merge: a map without cluster, more than ``most`` of whose members one cluster holds; it goes into that cluster's map;
    * idle: any other map without cluster (cluster is null); it stays as it is.

    Each cluster has one of the first three, each map at most one continue, merge or idle. Ties: the smaller key.
    """
    over = stored(overlaps(clusters, maps, 0.0))
    pairs = stored(matched(over.where(F.col("shared") >= least * F.least("cluster_size", "map_size"))))

    def heaviest(key: str, other: str) -> DataFrame:
        part = over.where(F.col("shared") > most * F.col(f"{key}_size")).join(pairs.select(key), key, "left_anti")
        return part.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("shared").desc(), other))).where("r = 1").select("cluster", "map", "shared")

    def rest(frame: DataFrame, key: str, found: DataFrame) -> DataFrame:
        return frame.select(key).where(F.col(key).isNotNull()).distinct().join(pairs.select(key), key, "left_anti").join(found.select(key), key, "left_anti")

    kinds = {c: over.schema[c].dataType for c in ("cluster", "map")}
    split, merge = stored(heaviest("cluster", "map")), stored(heaviest("map", "cluster"))
    new = rest(clusters, "cluster", split).select("cluster", F.lit(None).cast(kinds["map"]).alias("map"), F.lit("new").alias("event"), F.lit(0).cast("long").alias("shared"))
    idle = rest(maps, "map", merge).select(F.lit(None).cast(kinds["cluster"]).alias("cluster"), "map", F.lit("idle").alias("event"), F.lit(0).cast("long").alias("shared"))
    named = [d.select("cluster", "map", F.lit(event).alias("event"), "shared") for d, event in ((pairs, "continue"), (split, "split"), (merge, "merge"))]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(new).unionByName(idle)
