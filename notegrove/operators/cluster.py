"""Clusters of note vectors: components of the similarity graph, k-means, terms and signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrove.functions.ids import signature
from notegrove.functions.text import WORD
from notegrove.operators.vectors import knn
from notegrove.session import stored

#: Rows and centres of k-means that are compared at a time; the most vectors drawn at once as first centres, and the rounds of draws in
#: which one near to another of its round is refused.
BLOCK, DRAWN, CHOOSY = 1024, 4096, 12

def neighbours(vectors: DataFrame, k: int, threshold: float, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(a, b) of vectors whose similarity reaches the threshold, among the k nearest of each; queries go in blocks."""
    q = vectors.select(F.col(vec).alias("query_id"), F.col(embedding).alias("vector"))
    near = knn(vectors, q, k, exclude_self=True, vec=vec, embedding=embedding).where(F.col("similarity") >= threshold)
    return near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).distinct()


def components(links: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, cluster): the smallest id that links reach, by label propagation with pointer jumping."""
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    label = stored(nodes.select(F.col("id"), F.col("id").alias("cluster")))
    for _ in range(rounds):
        near = both.join(label, both["v"] == label["id"]).groupBy("u").agg(F.min("cluster").alias("m"))
        step = label.join(near, label["id"] == near["u"], "left").select("id", F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        jump = step.select(F.col("id").alias("j"), F.col("cluster").alias("to"))
        new = stored(step.join(jump, F.col("cluster") == F.col("j"), "left").select("id", F.least("cluster", F.coalesce("to", "cluster")).alias("cluster")))
        moved = new.join(label.withColumnRenamed("cluster", "old"), "id").where("cluster <> old").limit(1).count()
        label = new
        if not moved:
            return label
    raise RuntimeError("the labels did not settle")


def density_clusters(vectors: DataFrame, k: int = 10, threshold: float = 0.7, least: int = 5, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, cluster), deterministic: components of the neighbour graph; those under the least size are noise and dropped."""
    found = components(neighbours(vectors, k, threshold, vec, embedding), vectors.select(F.col(vec).alias("id")))
    big = found.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.join(big.select("cluster"), "cluster", "left_semi").select("id", "cluster")


class _Nearest:
    """The centre nearest to each row, ties to the first, by products of BLOCK rows and BLOCK centres at a time."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.norm = centres, (centres * centres).sum(1)

    def of(self, x: np.ndarray) -> np.ndarray:
        best, d = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        for r in range(0, len(x), BLOCK):
            own = slice(r, r + BLOCK)
            for c in range(0, len(self.centres), BLOCK):
                some = self.norm[c : c + BLOCK] - 2 * (x[own] @ self.centres[c : c + BLOCK].T)
                at = some.argmin(1)
                least = some[np.arange(len(at)), at]
                nearer = least < d[own]
                d[own][nearer], best[own][nearer] = least[nearer], c + at[nearer]
        return best


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def _accepted(drawn: np.ndarray, d: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Whether vectors drawn by their squared distances d from the centres are still taken when those taken before are centres too: with
    the share of the distance that is left. So each is drawn as k-means++ draws it."""
    left, taken, norm = d.copy(), np.zeros(len(d), bool), (drawn * drawn).sum(1)
    for i in range(len(d)):
        if chance[i] * d[i] < left[i]:
            taken[i] = True
            left = np.minimum(left, np.maximum(norm + norm[i] - 2 * (drawn @ drawn[i]), 0))
    return taken


def _first_centres(x: DataFrame, k: int) -> np.ndarray:
    """k different vectors of x (h, features), or all: one at random, then many a round with chances in proportion to the squared distance
    from those before. Chance is a hash of the vector and the round, so that it is the same however rows are dealt out."""
    spark, centres, number = x.sparkSession, None, 0
    while centres is None or len(centres) < k:
        held = spark.sparkContext.broadcast(None if centres is None else _Nearest(centres))

        def drawn(batches: Iterator[pa.RecordBatch], held=held, number=number) -> Iterator[pa.RecordBatch]:
            near = held.value
            for b in batches:
                h, v = b.column(0).to_numpy(), _matrix(b.column(1))
                u = h.astype(np.uint64) + np.uint64(number + 1) * np.uint64(0x9E3779B97F4A7C15)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    u = (u ^ (u >> np.uint64(shift))) * np.uint64(factor)
                draw = -np.log(((u >> np.uint64(11)) + 0.5) / 2.0**53)
                d = np.ones(len(h)) if near is None else ((v - near.centres[near.of(v)]) ** 2).sum(1)  # 0 of a centre itself
                some = np.flatnonzero(d > 0)
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(draw[some] / d[some])], names=["h", "draw"])

        room = 1 if centres is None else min(DRAWN, max(256, 2 * (k - len(centres))))
        top = x.select("h", "features").mapInArrow(drawn, "h long, draw double").groupBy("h").agg(F.min("draw").alias("draw")).orderBy("draw", "h").limit(room)
        got = x.join(F.broadcast(top), "h").groupBy("h").agg(F.min("draw").alias("draw"), F.min("features").alias("features")).toArrow().combine_chunks().sort_by([("draw", "ascending"), ("h", "ascending")])
        got = _matrix(got["features"].combine_chunks()) if len(got) else np.empty((0, 1))
        if centres is not None and len(got):
            near = _Nearest(centres)
            d = ((got - centres[near.of(got)]) ** 2).sum(1)
            chance = np.random.default_rng(number).random(len(d)) if number <= CHOOSY else np.zeros(len(d))
            got = got[_accepted(got, d, chance)][: k - len(centres)]
        if not len(got):
            break
        centres, number = got if centres is None else np.vstack([centres, got]), number + 1
    return centres


def kmeans(vectors: DataFrame, least: int = 5, seed: int = 42, vec: str = "vec_id", embedding: str = "embedding", rounds: int = 10, still: float = 1e-4) -> DataFrame:
    """(id, cluster) by k-means with k = min(max(2, n // least), n) in rounds, or until no centre moves further than ``still``; small clusters
    are dropped, and so are vectors with a null or a component that is none or not finite. Tasks compare their rows with all centres by
    products of blocks and add them up by centre; the driver holds the k centres, and an empty one stays."""
    spark = vectors.sparkSession
    value = F.col(embedding).cast("array<double>")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = vectors.where(F.col(embedding).isNotNull() & finite).select(F.col(vec).alias("id"), F.xxhash64(F.lit(seed), value).alias("h"), value.alias("features"))
    x = stored(x.repartition(spark.sparkContext.defaultParallelism, "h", "id"))
    n = x.count()
    k = min(max(2, n // least), n)
    if not n:
        return spark.createDataFrame([], x.select("id").schema.add("cluster", "integer"))
    centres = _first_centres(x, k)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cluster added up, in an order that does not hang on that of the rows."""
        whole = list(batches)
        if not sum(b.num_rows for b in whole):
            return
        c, m = (np.concatenate([b.column(i).to_numpy() for b in whole]) for i in (0, 1))
        sums = np.concatenate([_matrix(b.column(2)) for b in whole if b.num_rows])
        order = np.lexsort((sums[:, 0], m, c))
        found, first = np.unique(c[order], return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.add.reduceat(m[order], first)), _lists(np.add.reduceat(sums[order], first))], names=["cluster", "n", "sums"])

    for _ in range(rounds):
        held = spark.sparkContext.broadcast(_Nearest(centres))

        def summed(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            near = held.value
            sums, m = np.zeros_like(near.centres), np.zeros(len(near.centres), np.int64)
            for b in batches:
                v = _matrix(b.column(0))
                c = near.of(v)
                order = np.argsort(c, kind="stable")
                found, first, count = np.unique(c[order], return_index=True, return_counts=True)
                sums[found] += np.add.reduceat(v[order], first) if len(v) else 0
                m[found] += count
            some = np.flatnonzero(m)
            for i in range(0, len(some), BLOCK):
                at = some[i : i + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at]), _lists(sums[at])], names=["cluster", "n", "sums"])

        schema = "cluster long, n long, sums array<double>"
        got = x.select("features").mapInArrow(summed, schema).repartition("cluster").mapInArrow(added, schema).toArrow().combine_chunks()
        moved = centres.copy()
        moved[got["cluster"].to_numpy()] = _matrix(got["sums"].combine_chunks()) / got["n"].to_numpy()[:, None]
        far = ((moved - centres) ** 2).sum(1).max()
        centres = moved
        if far <= still**2:
            break
    held = spark.sparkContext.broadcast(_Nearest(centres))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.of(_matrix(b.column(1))).astype(np.int32))], names=["id", "cluster"])

    got = stored(x.select("id", "features").mapInArrow(assigned, x.select("id").schema.add("cluster", "integer")))
    big = got.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return got.join(big.select("cluster"), "cluster", "left_semi").select("id", "cluster")


def terms(titles: DataFrame, cluster: str, title: str, most: int = 10) -> DataFrame:
    """(cluster, terms): the tokens of two characters or more that occur most, in alphabetical order."""
    t = titles.select(F.col(cluster).alias("cluster"), F.explode(F.regexp_extract_all(F.lower(title), F.lit(rf"({WORD}{{2,}})"), F.lit(1))).alias("term"))
    n = t.groupBy("cluster", "term").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n").desc(), "term"))).where(F.col("r") <= most)
    return top.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("terms"))


def signatures(members: DataFrame, cluster: str, member: str) -> DataFrame:
    """(cluster, size, signature). A topic map's members are what one note lists."""
    return members.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("size"), signature(F.collect_list(F.col(member).cast("string"))).alias("signature"))


def new_members(members: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    return members.join(linked, keys, "left_anti")
