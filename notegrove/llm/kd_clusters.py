"""Centroid clustering by kd-tree filtering (operator 11).

Vectors are scaled to integers, and every task turns its rows into kd-trees of at most ``TREE_ROWS`` vectors: a node is a
stretch of the tree's points with its count, sum, sum of squares and box. Trees are written once, without a shuffle, and read
by every round. A round walks each tree with the centroids that may still be nearest to some point of a node: one that is
farther than another from every point of the node's box is pruned (only if strictly farther, so ties stay exact), a node
with one centroid left is assigned as a whole from its sums, and the points of a leaf are compared with those that are left.
All sums and distances are integers, so results do not depend on how the rows are dealt.

What reaches the driver is one sum a centroid and component; the centroids go out with the tasks. Both are as large as the number
of centroids, which is a parameter, whatever the number of vectors.

Edge cases: a vector that is null, has another number of components, or a null or non-finite one is left out, and so is one
with a scaled component beyond +-2^27, whose squared distances need not fit a long; rows are clustered one by one, equal
ones alike; a row without id is clustered but is no first centroid; with fewer vectors than centroids each is one; rows of one
id that differ start in the order of their components; an empty table gives no rows. Inertias are exact below 2^63. Columns
named in ``keep`` are passed on; a new column takes underscores before its name where that is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrove.llm.common import free, small_batches, stored

#: Vectors a tree and vectors a leaf at most; tree rows in a batch between the JVM and Python.
TREE_ROWS, LEAF_ROWS, BATCH_TREES = 1024, 16, 64
LIMIT = 1 << 27
#: Below this bound products of components are exact in floating point.
_EXACT = 1 << 21
_NODES = ("child", "begin", "end", "low", "high", "sums", "squares")
_DTYPES = {"child": np.int32, "begin": np.int32, "end": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64, "squares": np.int64}


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Batches between the JVM and Python of so many rows, for the jobs that end inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def integers(vector: str, scale: int) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * float(scale)).cast("int"))


def usable(vector: str, dimensions: int, scale: int) -> Column:
    """Whether a vector is clustered at all."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * float(scale) <= float(LIMIT))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) == dimensions) & F.forall(vector, fine), F.lit(False))


def grown(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the points, nodes). A node's children are ``child`` and the next one; a leaf has none (-1). A node is split at
    the median of its widest component."""
    order = np.arange(len(points))
    child, begin, end, low, high = [-1], [0], [len(points)], [], []
    node = 0
    while node < len(child):
        a, b = begin[node], end[node]
        own = points[order[a:b]]
        lo, hi = own.min(0), own.max(0)
        low.append(lo)
        high.append(hi)
        widest = int(np.argmax(hi.astype(np.int64) - lo))
        if b - a > LEAF_ROWS and hi[widest] > lo[widest]:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, widest], middle)]
            child[node] = len(child)
            child += [-1, -1]
            begin += [a, a + middle]
            end += [a + middle, b]
        node += 1
    laid = points[order].astype(np.int64)
    nodes = {"child": np.array(child), "begin": np.array(begin), "end": np.array(end), "low": np.array(low), "high": np.array(high)}
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(laid, 0)])
    squares = np.concatenate([[0], np.cumsum((laid * laid).sum(1))])
    nodes["sums"] = running[nodes["end"]] - running[nodes["begin"]]
    nodes["squares"] = squares[nodes["end"]] - squares[nodes["begin"]]
    return order, nodes


def kd_trees(vectors: DataFrame, vector: str = "embedding", dimensions: int = 64, scale: int = 256, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """A row a tree: its rows' ``keep`` columns, its points in the order of the tree, and its nodes."""
    name = free("points", list(keep))
    source = vectors.where(usable(vector, dimensions, scale)).select(*keep, integers(vector, scale).alias(name))
    schema = T.StructType([T.StructField("rows", T.ArrayType(vectors.select(*keep).schema))])
    for c in ("points", *_NODES):
        schema = schema.add(c, "binary")

    def tree(table: pa.Table) -> pa.RecordBatch:
        flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        points = np.ascontiguousarray(flat, np.int32).reshape(-1, dimensions)
        order, nodes = grown(points)
        taken = table.take(pa.array(order)).select(list(keep)).combine_chunks()
        struct = pa.StructArray.from_arrays([taken.column(c).combine_chunks() for c in keep], names=list(keep))
        rows = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), struct)
        packed = [pa.array([nodes[c].astype(_DTYPES[c]).tobytes()]) for c in _NODES]
        return pa.RecordBatch.from_arrays([rows, pa.array([points[order].tobytes()]), *packed], names=["rows", "points", *_NODES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            while len(b) and (room := TREE_ROWS - sum(map(len, held))) <= len(b):
                yield tree(pa.Table.from_batches([*held, b.slice(0, room)]))
                held, b = [], b.slice(room)
            if len(b):
                held.append(b)
        if held:
            yield tree(pa.Table.from_batches(held))

    return source.mapInArrow(run, schema)


class Tree:
    """One stored row, ready to be walked."""

    def __init__(self, row: dict, dimensions: int):
        for c in ("points", *_NODES):
            flat = np.frombuffer(row[c], _DTYPES.get(c, np.int32))
            setattr(self, c, flat.reshape(-1, dimensions) if c in ("points", "low", "high", "sums") else flat)

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(node, its one centroid, None) for each node assigned as a whole, (leaf, its points' centroids, their squared
        distances) for each leaf that was resolved."""
        norms = (centroids * centroids).sum(1)
        exact = max(int(np.abs(centroids).max()), int(np.abs(self.low[0]).max()), int(np.abs(self.high[0]).max())) <= _EXACT
        todo = [(0, np.arange(len(centroids)))]
        while todo:
            node, left = todo.pop()
            if len(left) > 1:
                lo, hi, z = self.low[node].astype(np.int64), self.high[node].astype(np.int64), centroids[left]
                off = z * 2.0 - (lo + hi)
                best = int(np.einsum("ij,ij->i", off, off).argmin())
                toward = z - z[best]
                # how much nearer than the best one each is at the corner of the box that suits it most
                gap = norms[left] - norms[left[best]] - 2 * (np.where(toward > 0, hi, lo) * toward).sum(1)
                stays = (gap <= 0) & toward.any(1)  # of equal centroids only the first counts
                stays[best] = True
                left = left[stays]
            if len(left) == 1:
                yield node, left, None
            elif self.child[node] < 0:
                own = self.points[self.begin[node] : self.end[node]]
                if exact:
                    x, z = own.astype(np.float64), centroids[left].astype(np.float64)
                    d = ((x * x).sum(1)[:, None] - 2 * (x @ z.T) + (z * z).sum(1)).astype(np.int64)
                else:
                    d = np.stack([((own.astype(np.int64) - c) ** 2).sum(1) for c in centroids[left]], 1)
                near = d.argmin(1)  # of equal ones the first, and candidates are in order
                yield node, left[near], d[np.arange(len(own)), near]
            else:
                todo += [(int(self.child[node]) + 1, left), (int(self.child[node]), left)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield {c: b.column(c)[i].as_py() for c in ("points", *_NODES)}


#: Besides a component's sum: the count, the sum of squares (modulo 2^64), and the vectors assigned in whole nodes.
COUNT, SQUARES, WHOLE = -1, -2, -3


def filtered(trees: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Sum by (centroid, component) over all vectors by their nearest centroid, with COUNT, SQUARES and WHOLE."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, other = np.zeros((k, dimensions), np.int64), np.zeros((k, 3), np.int64)
        for row in _rows(batches):
            tree = Tree(row, dimensions)
            for node, near, d in tree.walk(centroids):
                if d is None:
                    n = int(tree.end[node] - tree.begin[node])
                    sums[near[0]] += tree.sums[node]
                    other[near[0]] += (n, tree.squares[node], n)
                else:
                    own = tree.points[tree.begin[node] : tree.end[node]].astype(np.int64)
                    np.add.at(sums, near, own)
                    np.add.at(other, near, np.stack([np.ones(len(own), np.int64), (own * own).sum(1), np.zeros(len(own), np.int64)], 1))
        every = np.concatenate([sums, other], 1)
        at = np.flatnonzero(other[:, 0])
        part = [*range(dimensions), COUNT, SQUARES, WHOLE]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, len(part)).astype(np.int32)), pa.array(np.tile(part, len(at)).astype(np.int32)), pa.array(every[at].ravel())], names=["cluster", "part", "v"]
        )

    with batches_of(trees.sparkSession, BATCH_TREES):
        out = trees.select("points", *_NODES).mapInArrow(run, "cluster int, part int, v long")
        return {(r[0], r[1]): int(r[2]) for r in out.groupBy("cluster", "part").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect()}


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows' kept columns with cluster and distance (squared)."""
    kept = trees.schema["rows"].dataType.elementType
    names = list(kept.names)
    cluster, distance = free("cluster", names), free("distance", names)
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(_rows([b])):
                tree = Tree(row, dimensions)
                near, far = np.zeros(len(tree.points), np.int32), np.zeros(len(tree.points), np.int64)
                for node, z, d in tree.walk(centroids):
                    at = slice(tree.begin[node], tree.end[node])
                    near[at] = z
                    far[at] = d if d is not None else ((tree.points[at] - centroids[z[0]]) ** 2).sum(1)
                rows = b.column("rows").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(near), pa.array(far)], names=[*names, cluster, distance])

    schema = T.StructType(list(kept.fields)).add(cluster, "integer").add(distance, "long")
    return trees.mapInArrow(run, schema)


def first_centroids(vectors: DataFrame, k: int, vector: str, ident: str, dimensions: int, scale: int, prefix: str) -> np.ndarray:
    """The k vectors whose prefixed ids hash lowest; only these reach the driver."""
    rows = (
        vectors.where(usable(vector, dimensions, scale) & F.col(ident).isNotNull())
        .select(F.sha2(F.concat(F.lit(prefix), F.col(ident).cast("string")), 256).alias("h"), integers(vector, scale).alias("p"))
        .orderBy("h", "p").limit(k).collect()
    )
    return np.array([r["p"] for r in rows], np.int64).reshape(-1, dimensions)


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def clustered(
    vectors: DataFrame, k: int = 40, rounds: int = 5, vector: str = "embedding", ident: str = "vec_id", dimensions: int = 64, scale: int = 256, prefix: str = "2:", keep: tuple[str, ...] = ("vec_id",)
) -> DataFrame:
    """``keep`` columns with cluster, distance, cluster_inertia, inertia and centroid_sha256, a row for each usable vector."""
    spark = vectors.sparkSession
    small_batches(spark)
    trees = stored(kd_trees(vectors, vector, dimensions, scale, keep))
    centroids = first_centroids(vectors, k, vector, ident, dimensions, scale, prefix)
    if not len(centroids):  # nothing to compare with: no rows, as there is no vector with an id
        names = free("cluster", list(keep)), free("distance", list(keep))
        rows = vectors.limit(0).select(*keep, F.lit(0).alias(names[0]), F.lit(0).cast("long").alias(names[1]))
        inertias, digests = [], []
    else:
        for _ in range(rounds):
            got = filtered(trees, centroids)
            for c in {c for c, _ in got}:
                centroids[c] = [got[c, i] // got[c, COUNT] for i in range(dimensions)]
        got = filtered(trees, centroids)
        exact = [[int(x) for x in c] for c in centroids]
        inertias = [_signed(got.get((c, SQUARES), 0) - 2 * sum(x * got.get((c, i), 0) for i, x in enumerate(z)) + got.get((c, COUNT), 0) * sum(x * x for x in z)) for c, z in enumerate(exact)]
        digests = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in exact]
        with batches_of(spark, BATCH_TREES):
            rows = stored(assigned(trees, centroids))
    cluster = rows.columns[len(keep)]
    on, own, total, digest = (free(c, rows.columns) for c in ("centroid", "cluster_inertia", "inertia", "centroid_sha256"))
    table = spark.createDataFrame([(c, x, _signed(sum(inertias)), h) for c, (x, h) in enumerate(zip(inertias, digests, strict=True))], f"`{on}` int, `{own}` long, `{total}` long, `{digest}` string")
    # a row a centroid, a parameter: broadcast whatever the number of vectors
    return rows.join(F.broadcast(table), F.col(cluster) == F.col(on)).drop(on)


def op11_kd_clusters(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
