"""Density clusters: mutual reachability, a distributed minimum spanning tree, and the clusters of its condensed tree that
have the most stability; rows in none of them are noise.

Distances are exact. Each row's nearest neighbours give its core distance and most edges of the tree; Boruvka rounds add the least edge
out of components. Those whose rows could have a shorter one beyond their lists wait until no other is left, and then all but the largest are
searched for. Neighbours and edges are found between blocks of rows that lie together, by cells of ``ann``: every two blocks meet in a task, which
passes over rows that are too far, and only what it finds is shuffled; so time may grow with the square of the rows, and what is shuffled and
written with the rows. Of many equal vectors one is compared. Edges are ordered by (weight, smaller, larger number), so the tree is one and the same however the rows are dealt.

The tree's merges are found piece by piece: a piece of more than ``PIECE`` edges is cut at its median, its light half falls into
components, each a piece of its own, and its heavy half is a piece over these components, so a task orders PIECE edges at most and
the pieces are as deep as the logarithm of the edges. Clusters follow by pointer jumping over merges of ``least`` rows or more. The tree of clusters, a
row a cluster, is settled in one task up to ``PIECE`` rows and beyond that level by level.

Edge cases: rows without id or vector and those of other dimensions are left out; equal vectors are at distance 0, whose density
counts as 1 / ``ZERO``; ids are taken as distinct (of equal ids one stays); fewer rows than ``least`` are all noise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrove.operators import ann
from notegrove.operators.cluster import components
from notegrove.session import stored

PIECE, ZERO = 1 << 20, 1e-12
#: Neighbours of a row that are listed, beyond those of its core distance.
LISTED = 8
#: Bytes of a block of vectors, rows of it that are compared at a time, and bytes of the vectors that a task lets blocks meet.
BLOCK_BYTES, TABLE, PART_BYTES = 2 << 20, 1024, 64 << 20


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place (from 0) in an order of all of them; only a row a task reaches the driver."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.shiftright("__id", 33)  # of these ids, the lower 33 bits number the rows of a task
    rows = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    before, at = [], 0
    for k, count in sorted(map(tuple, rows.groupBy(part).count().collect())):
        before.append((k, at))
        at += count
    first = F.broadcast(spark.createDataFrame(before, "__part long, __before long"))
    return rows.join(first, part == F.col("__part")).withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__before")


def _in_one_task(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over all rows at once; for frames whose size has been checked."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held:
            yield f(pd.concat(held, ignore_index=True))

    return rows.repartition(1).mapInPandas(run, schema)


def _least(top: dict[int, int], x: int) -> int:
    root = x
    while top.setdefault(root, root) != root:
        root = top[root]
    while top[x] != root:
        top[x], x = root, top[x]
    return root


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, cluster): the smallest id that links (a, b) reach; a row without b is an id alone."""
    top: dict[int, int] = {}
    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        x, y = _least(top, a), _least(top, b)
        top[max(x, y)] = min(x, y)
    return pd.DataFrame({"id": list(top), "cluster": [_least(top, x) for x in list(top)]})


def _components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cluster) of nodes (id) under links (a, b): in one task up to PIECE rows, beyond that by rounds."""
    every = stored(links.select("a", "b").unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    if every.count() <= PIECE:
        return _in_one_task(every, _joined, "id long, cluster long")
    return components(links, nodes)


def _paired(asked: DataFrame, held: DataFrame, size: int) -> DataFrame:
    """Each block of asked beside each one of held (size: bytes of all of these): a task takes some of the one and a part of the other, so
    pairs are made where they are used and none is shuffled or stored."""
    n, blocks = max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))), max(1, asked.count())
    left = min(n, blocks)
    return asked.repartition(left).crossJoin(held.repartition(max(-(-size // PART_BYTES), -(-n // left))).hint("shuffle_replicate_nl"))


class _Asked:
    """A block of rows that others are compared with, and what is the same for all comparisons. v: as many bytes as the width says a component."""

    def __init__(self, v: bytes, dims: int, width: int):
        self.v = np.frombuffer(v, f"f{width}").reshape(-1, dims)
        self.norm = np.square(self.v, dtype=np.float64).sum(1)

    def near(self, x: np.ndarray, norm: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(own rows, their squared distances from x, bounds of the error of these) of own rows that may be within limit (squared) of some row of x."""
        middle = x.mean(0, dtype=np.float64)
        far = np.sqrt(ann._distances(x.astype(np.float64), middle[None]).max())
        off = np.sqrt(ann._distances(self.v.astype(np.float64), middle[None])[:, 0])
        some = np.flatnonzero(off - far <= np.sqrt(limit) + 1e-6 * (1 + off + far))
        largest = max(float(norm.max()), float(self.norm.max()))
        kind = np.float32 if x.dtype == np.float32 and largest < 1e30 else np.float64
        slack = 2e-9 + (x.shape[1] + 16) * 2 * np.finfo(kind).eps
        y, own = x.astype(kind, copy=False).T, norm.astype(kind)
        for i in range(0, len(some), TABLE):
            s = some[i : i + TABLE]
            d = (-2 * self.v[s].astype(kind)) @ y
            d += own
            d += self.norm[s].astype(kind)[:, None]
            yield s, d, slack * (1 + self.norm[s] + norm.max())


class _Nearest(_Asked):
    """The k nearest of each row of a block among the rows that it has met, by rounded distance, then id."""

    def __init__(self, v: bytes, ids: bytes, dims: int, width: int, k: int):
        super().__init__(v, dims, width)
        self.ids, self.k = np.frombuffer(ids, "i8"), k
        self.d, self.at = np.full((len(self.ids), k), np.inf), np.full((len(self.ids), k), np.iinfo(np.int64).max)
        self.limit = np.full(len(self.ids), np.inf)
        first = self.v[:TABLE]
        if len(first) > k:  # some rows of its own block, itself among them: no row needs to look farther than the k + 1-th of these
            for s, d, error in self.near(first, self.norm[:TABLE], self.limit):
                self.limit[s] = np.partition(d, k, 1)[:, k] + error

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        k, norm = self.k, np.square(x, dtype=np.float64).sum(1)
        limit = np.minimum(self.d[:, -1], self.limit)
        for s, d, error in self.near(x, norm, limit):
            most = limit[s] + error
            if d.shape[1] > k + 1 and not np.isfinite(most).all():
                most = np.minimum(most, np.partition(d, k, 1)[:, k] + 2 * error)
            r, c = np.nonzero(d <= most[:, None])
            other = self.ids[s[r]] != ids[c]
            r, c = r[other], c[other]
            if not len(r):
                continue
            exact = np.concatenate([_between(self.v[s[r[j : j + 65536]]], x[c[j : j + 65536]]) for j in range(0, len(r), 65536)])
            own = np.unique(r)
            row, dist, at = np.append(np.repeat(own, k), r), np.append(self.d[s[own]], exact), np.append(self.at[s[own]], ids[c])
            order = np.lexsort((at, np.round(dist, 9), row))
            take = order[(np.searchsorted(row[order], own)[:, None] + np.arange(k)).ravel()]
            self.d[s[own]], self.at[s[own]] = dist[take].reshape(-1, k), at[take].reshape(-1, k)

    def found(self) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.at[row, col]), pa.array(self.d[row, col])], names=["query_id", "id", "distance"])


def _between(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ann.between(y.astype(np.float64), x.astype(np.float64)[:, None, :])[:, 0]


class _Least(_Asked):
    """The least edge out of each component that has rows in a block, among the rows that the block has met."""

    def __init__(self, v: bytes, ids: bytes, comp: bytes, core: bytes, bound: bytes, dims: int, width: int):
        super().__init__(v, dims, width)
        self.ids, self.core = np.frombuffer(ids, "i8"), np.frombuffer(core, "f8")
        self.comps, self.of = np.unique(np.frombuffer(comp, "i8"), return_inverse=True)
        self.bound = np.full(len(self.comps), np.inf)
        self.bound[self.of] = np.frombuffer(bound, "f8")  # one for all rows of a component
        self.edges: dict[int, tuple] = {}

    def add(self, x: np.ndarray, ids: np.ndarray, comp: np.ndarray, core: np.ndarray) -> None:
        live = core <= self.bound.max()
        if len(self.comps) == 1:
            live &= comp != self.comps[0]
        if not live.any():
            return
        x, ids, comp, core = x[live], ids[live], comp[live], core[live]
        norm, squared = np.square(x, dtype=np.float64).sum(1), core * core
        for s, d, error in self.near(x, norm, (self.bound * self.bound)[self.of]):
            of = self.of[s]
            np.maximum(d, squared.astype(d.dtype), out=d)
            d[self.comps[of][:, None] == comp] = np.inf
            least = np.full(len(self.comps), np.inf)
            np.minimum.at(least, of, np.maximum(d.min(1), (self.core * self.core)[s]) + 2 * error)
            most = np.minimum(least, self.bound * self.bound)[of] + error
            r, c = np.nonzero(d <= np.minimum(most, np.finfo(d.dtype).max)[:, None])
            # those that rounding keeps near the least are measured again, so that weights have the same bits from either side
            for j in range(0, len(r), 65536):
                q, i = s[r[j : j + 65536]], c[j : j + 65536]
                w = np.maximum(np.maximum(self.core[q], core[i]), np.sqrt(_between(self.v[q], x[i])))
                small, large = np.minimum(self.ids[q], ids[i]), np.maximum(self.ids[q], ids[i])
                order = np.lexsort((large, small, w, self.of[q]))
                for f in order[np.unique(self.of[q][order], return_index=True)[1]].tolist():
                    own, edge = int(self.of[q[f]]), (float(w[f]), int(small[f]), int(large[f]), int(comp[i[f]]))
                    if edge[0] <= self.bound[own] and (own not in self.edges or edge < self.edges[own]):
                        self.edges[own], self.bound[own] = edge, edge[0]

    def found(self) -> pa.RecordBatch:
        w, a, b, to = zip(*self.edges.values(), strict=True) if self.edges else ((), (), (), ())
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        columns = ([int(self.comps[c]) for c in self.edges], w, a, b, to)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["comp", "w", "a", "b", "to"])


def _packed(rows: DataFrame, kinds: dict[str, str], dims: int, width: int, n: int) -> DataFrame:
    """Stored blocks of BLOCK_BYTES of rows (about n), a cell's rows side by side."""
    spark = rows.sparkSession
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n * dims * width // BLOCK_BYTES))
    with ann.batches_of(spark, max(1, BLOCK_BYTES // (width * dims))):
        return stored(ann.packed(rows, kinds, dims, width, BLOCK_BYTES, tasks))


def _met(asked: DataFrame, held: DataFrame, size: int, made: Callable[[dict], _Asked], given: Callable[[dict], tuple], schema: str) -> DataFrame:
    """What each block of asked (its columns begin with q_) finds among all blocks of held; a task lets one block after another meet its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if block is None or row["q_id"][:8] != now:  # ids are distinct
                    if block is not None:
                        yield block.found()
                    now, block = row["q_id"][:8], made(row)
                block.add(*given(row))
        if block is not None:
            yield block.found()

    with ann.batches_of(asked.sparkSession, 8):
        return stored(_paired(asked, held, size).mapInArrow(run, schema))


def nearest(rows: DataFrame, n: int, dims: int, k: int) -> DataFrame:
    """(query_id, id, distance, vector_rank): the k nearest other rows of each of n rows (id, v, cell), by squared distance. Blocks of rows meet
    each other in tasks, and of a task only the k best of a row are shuffled."""
    width = 4 if ann.kind_of(rows, "v") == "array<float>" else 8
    blocks = _packed(rows, {"id": "i8"}, dims, width, n)
    asked = blocks.select(*(F.col(c).alias(f"q_{c}") for c in ("v", "id")))
    get = lambda r: (np.frombuffer(r["v"], f"f{width}").reshape(-1, dims), np.frombuffer(r["id"], "i8"))
    return ann.ranked(_met(asked, blocks.select("v", "id"), n * dims * width, lambda r: _Nearest(r["q_v"], r["q_id"], dims, width, k), get, "query_id long, id long, distance double"), k)


def _outside(rows: DataFrame, n: int, dims: int, asked: DataFrame) -> DataFrame:
    """(comp, w, a, b, to): least edges out of the components of asked rows, none above its component's bound; of each component the least is
    among them. rows: (id, v, cell, comp, core); asked: the same and bound."""
    width = 4 if ann.kind_of(rows, "v") == "array<float>" else 8
    kinds = {"id": "i8", "comp": "i8", "core": "f8"}
    held = _packed(rows, kinds, dims, width, n).select("v", *kinds)
    names = ("v", *kinds, "bound")
    blocks = _packed(asked, kinds | {"bound": "f8"}, dims, width, n).select(*(F.col(c).alias(f"q_{c}") for c in names))
    get = lambda r: (np.frombuffer(r["v"], f"f{width}").reshape(-1, dims), *(np.frombuffer(r[c], kind) for c, kind in kinds.items()))
    return _met(blocks, held, n * dims * width, lambda r: _Least(*(r[f"q_{c}"] for c in names), dims, width), get, "comp long, w double, a long, b long, to long")


def _once(rows: DataFrame, samples: int) -> tuple[DataFrame, DataFrame]:
    """(rows with of more than ``samples`` equal vectors the smallest id only, and whether a row stands for others (many); edges (a, b, w) from it
    to the others). These are the tree's: all are at distance 0 with core distances of 0, and the smallest ids come first."""
    groups = rows.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where(F.col("copies") > samples).drop("copies")
    of = stored(rows.join(groups, "v", "left"))
    one = of.where(F.col("first").isNull() | (F.col("first") == F.col("id"))).select("id", "v", "cell", F.col("first").isNotNull().alias("many"))
    return one, of.where(F.col("first") < F.col("id")).select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))


def spanning_tree(rows: DataFrame, dims: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """((a, b, w) of the minimum spanning tree under mutual reachability, (id, core)); of many equal rows the first only has a core distance here.
    rows: (id, v, cell), ids distinct."""
    k = samples + LISTED
    rows, copies = _once(rows, samples)
    n = rows.count()
    if n < 2:
        return copies, rows.select("id", F.lit(0.0).alias("core"))
    many = rows.where("many").select("id", F.lit(0.0).alias("zero"))
    near = stored(nearest(rows, n, dims, k))
    # a row that stands for many is as many neighbours as a core distance takes
    listed = near.join(many, "id", "left").groupBy(F.col("query_id").alias("id")).agg(F.max(F.when(F.col("vector_rank") <= samples, F.col("distance"))).alias("last"), F.min(F.when(F.col("zero").isNotNull(), F.col("distance"))).alias("dense"))
    cores = listed.join(many, "id", "left").select("id", F.coalesce("zero", F.sqrt(F.least("last", "dense"))).alias("core"))
    # beyond its list a row has nothing nearer than the list's last; a list that is not full has all
    reach = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.sqrt(F.max("distance"))).otherwise(F.lit(float("inf"))).alias("reach"))
    points = stored(cores.join(reach, "id"))
    a, b = points.select(F.col("id").alias("query_id"), F.col("core").alias("ca")), points.select("id", F.col("core").alias("cb"))
    edges = near.join(a, "query_id").join(b, "id").select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), F.greatest("ca", "cb", F.sqrt("distance")).alias("w")).distinct()
    labels = points.select("id", F.col("id").alias("comp"))
    tree = None
    while True:
        of = lambda side: labels.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))  # noqa: B023, E731
        edges = stored(edges.select("a", "b", "w").join(of("a"), "a").join(of("b"), "b").where("ca <> cb"))
        both = edges.select(F.col("ca").alias("comp"), "w", "a", "b", F.col("cb").alias("to")).unionByName(edges.select(F.col("cb").alias("comp"), "w", "a", "b", F.col("ca").alias("to")))
        best = both.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e"))
        here = points.join(labels, "id")
        comps = stored(here.groupBy("comp").agg(F.count("*").alias("n"), F.min("reach").alias("reach")).join(best, "comp", "left"))
        # a component with a better edge than anything beyond its rows' lists needs no search; the others wait while there are any such
        picked = comps.where("reach > e.w").select("comp", "e")
        if picked.isEmpty():
            # the edges of all components but the largest join them: its rows, most of all, need no search of their own
            largest = comps.orderBy(F.col("n").desc(), "comp").first()["comp"]
            here = rows.join(here, "id").select("id", "v", "cell", "comp", "core", "reach")
            bounds = comps.where(F.col("comp") != largest).select("comp", F.coalesce("e.w", F.lit(float("inf"))).alias("bound"))
            far = _outside(here.drop("reach"), n, dims, here.join(bounds, "comp").where(F.col("reach") <= F.col("bound")).drop("reach"))
            picked = both.unionByName(far).where(F.col("comp") != largest).groupBy("comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e"))
            edges = edges.select("a", "b", "w").unionByName(far.select("a", "b", "w")).distinct()
        picks = stored(picked.select(F.least("comp", "e.to").alias("x"), F.greatest("comp", "e.to").alias("y"), "e.a", "e.b", "e.w").distinct())
        if picks.isEmpty():
            break
        tree = picks.select("a", "b", "w") if tree is None else tree.unionByName(picks.select("a", "b", "w"))
        merged = _components(picks.select(F.col("x").alias("a"), F.col("y").alias("b")), comps.select(F.col("comp").alias("id")))
        labels = stored(labels.join(merged.select(F.col("id").alias("comp"), F.col("cluster").alias("new")), "comp").select("id", F.col("new").alias("comp")))
        if labels.select("comp").distinct().limit(2).count() < 2:
            break
    return (copies if tree is None else tree.unionByName(copies)), points.select("id", "core")


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The merges of one piece, its edges in order: what each joins and how large both are."""
    pdf = pdf.sort_values("r")
    top: dict[int, int] = {}
    size: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := top.setdefault(root, root)) != root:
            root = up
        while top[x] != root:
            top[x], x = root, top[x]
        return root

    out = []
    for node, a, sa, b, sb in zip(*(pdf[c].tolist() for c in ("node", "a", "sa", "b", "sb")), strict=True):
        size.setdefault(a, sa)
        size.setdefault(b, sb)
        x, y = find(a), find(b)
        out.append((node, x, size[x], y, size[y]))
        top[x] = top[y] = top[node] = node
        size[node] = size[x] + size[y]
    return pd.DataFrame(out, columns=["node", "x", "sx", "y", "sy"])


def merges(edges: DataFrame, n: int) -> DataFrame:
    """(node, x, sx, y, sy): what each edge (r, a, b), in the order r from 0, of a tree over vertices 0..n-1 joins: vertices, or
    the merges n + r of lighter edges, with their sizes."""
    one = F.lit(1).cast("long")
    todo = stored(edges.select(F.lit(-1).cast("long").alias("piece"), "r", (F.col("r") + n).alias("node"), "a", one.alias("sa"), "b", one.alias("sb")))
    out = None
    while True:
        sizes = todo.groupBy("piece").agg(F.count("*").alias("n"), F.percentile_approx("r", 0.5).alias("mid"), F.max("r").alias("most"))
        sizes = stored(sizes.withColumn("mid", F.least("mid", F.col("most") - 1)))
        small = todo.join(sizes.where(F.col("n") <= PIECE).select("piece"), "piece", "left_semi")
        done = small.groupBy("piece").applyInPandas(_merged, "node long, x long, sx long, y long, sy long")
        out = done if out is None else out.unionByName(done)
        big = sizes.where(F.col("n") > PIECE)
        if big.isEmpty():
            return stored(out)
        split = stored(todo.join(big.select("piece", "mid"), "piece"))
        light, heavy = split.where("r <= mid"), split.where("r > mid")
        ends = light.select(F.col("a").alias("v"), F.col("sa").alias("s")).unionByName(light.select(F.col("b").alias("v"), F.col("sb").alias("s"))).distinct()
        comp = _components(light.select("a", "b"), ends.select(F.col("v").alias("id"))).withColumnsRenamed({"id": "v", "cluster": "comp"})
        mass = ends.join(comp, "v").groupBy("comp").agg(F.sum("s").alias("mass"))
        lit = light.join(comp.withColumnRenamed("v", "a"), "a")
        tops = lit.groupBy("comp").agg(F.max("node").alias("top")).join(mass, "comp")  # a component's last merge stands for it
        of = stored(comp.join(tops, "comp"))
        lit = lit.join(tops.select("comp", "top"), "comp").select(F.col("top").alias("piece"), "r", "node", "a", "sa", "b", "sb")
        for side, s in (("a", "sa"), ("b", "sb")):
            it = of.select(F.col("v").alias(side), F.col("top").alias("__t"), F.col("mass").alias("__m"))
            heavy = heavy.join(it, side, "left").withColumn(side, F.coalesce("__t", side)).withColumn(s, F.coalesce("__m", s)).drop("__t", "__m")
        todo = stored(lit.unionByName(heavy.drop("mid").select("piece", "r", "node", "a", "sa", "b", "sb")))


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    to = dict(zip(pdf["node"].tolist(), pdf["up"].tolist(), strict=True))
    last: dict[int, int] = {}
    for node in to:
        chain = []
        while node not in last and node in to and to[node] != node:
            chain.append(node)
            node = to[node]
        end = last.get(node, node)
        last[node] = end
        for x in chain:
            last[x] = end
    return pd.DataFrame({"node": list(to), "up": [last[x] for x in to]})


def _jumped(up: DataFrame) -> DataFrame:
    """(node, up) with every pointer at the end of its chain; the ends point at themselves or at nodes without a row. In one task up
    to PIECE rows, beyond that by doubling."""
    up = stored(up)
    if up.count() <= PIECE:
        return _in_one_task(up, _ends, "node long, up long")
    while True:
        to = up.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
        new = stored(up.join(to, F.col("up") == F.col("__n"), "left").select("node", F.coalesce("__u", "up").alias("up"), (F.coalesce("__u", "up") != F.col("up")).alias("moved")))
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            return up


def _chosen(tree: pd.DataFrame) -> pd.DataFrame:
    """(cluster, chosen): for each cluster the one, itself or above it, that has more stability than the clusters below it (null:
    none). tree: (cluster, parent, stability), the root with a null parent, which is never chosen."""
    parent = {c: None if pd.isna(p) else int(p) for c, p in zip(tree["cluster"].tolist(), tree["parent"].tolist(), strict=True)}
    value = dict(zip(tree["cluster"].tolist(), tree["stability"].tolist(), strict=True))
    below: dict[int, float] = {}
    pending: dict[int, int] = {}
    for p in parent.values():
        if p is not None:
            pending[p] = pending.get(p, 0) + 1
    ready, order, own = [c for c in parent if c not in pending], [], {}
    while ready:
        c = ready.pop()
        order.append(c)
        own[c] = parent[c] is not None and value[c] >= below.get(c, 0.0)
        p = parent[c]
        if p is not None:
            below[p] = below.get(p, 0.0) + max(value[c], below.get(c, 0.0))
            pending[p] -= 1
            if not pending[p]:
                ready.append(p)
    chosen: dict[int, int | None] = {}
    for c in reversed(order):
        above = chosen.get(parent[c]) if parent[c] is not None else None
        chosen[c] = above if above is not None else c if own[c] else None
    return pd.DataFrame({"cluster": list(chosen), "chosen": pd.array(list(chosen.values()), dtype="Int64")})


def _chosen_by_levels(tree: DataFrame) -> DataFrame:
    """As ``_chosen``, for more clusters than a task takes: leaves first, a round a level of the tree."""
    kids = tree.groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("kids"))
    left = stored(tree.join(kids, "cluster", "left").withColumns({"kids": F.coalesce("kids", F.lit(0)), "below": F.lit(0.0)}))
    done = None
    while not left.isEmpty():
        now = stored(left.where("kids = 0").withColumn("own", F.col("parent").isNotNull() & (F.col("stability") >= F.col("below"))))
        done = now if done is None else done.unionByName(now)
        up = now.groupBy(F.col("parent").alias("__p")).agg(F.count("*").alias("__k"), F.sum(F.greatest("stability", "below")).alias("__b"))
        rest = left.where("kids > 0").join(up, F.col("cluster") == F.col("__p"), "left")
        left = stored(rest.withColumns({"kids": F.col("kids") - F.coalesce("__k", F.lit(0)), "below": F.col("below") + F.coalesce("__b", F.lit(0.0))}).drop("__p", "__k", "__b"))
    # the highest one of its own accord at or above each: from the top, a round a level
    out = level = stored(done.where("parent is null").select("cluster", F.lit(None).cast("long").alias("chosen")))
    while True:
        above = level.select(F.col("cluster").alias("parent"), F.col("chosen").alias("above"))
        level = stored(done.join(above, "parent").select("cluster", F.coalesce("above", F.when(F.col("own"), F.col("cluster"))).alias("chosen")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def condensed(tree: DataFrame, n: int, least: int) -> DataFrame:
    """(vertex, chosen): the chosen cluster of each vertex 0..n-1, null for noise. tree: (node, x, sx, y, sy, w) of all merges."""
    density = 1.0 / F.greatest("w", F.lit(ZERO))
    side = lambda c, s, t: tree.select(F.col(c).alias("child"), F.col(s).alias("size"), F.col(t).alias("other"), F.col("node").alias("parent"), density.alias("density"))
    kids = stored(side("x", "sx", "sy").unionByName(side("y", "sy", "sx")))
    big = stored(tree.where(F.col("sx") + F.col("sy") >= least).select("node", density.alias("density")))
    born = kids.where((F.col("size") >= least) & (F.col("other") >= least))  # both sides of a merge are large: clusters
    root = F.lit(2 * n - 2).cast("long")
    # a large merge belongs to its own cluster if it was born, else to that of the merge above
    heads = born.select(F.col("child").alias("node"), F.col("child").alias("up")).unionByName(big.where(F.col("node") == root).select("node", F.col("node").alias("up")))
    chain = kids.where((F.col("size") >= least) & (F.col("other") < least)).select(F.col("child").alias("node"), F.col("parent").alias("up"))
    belongs = _jumped(heads.unionByName(chain)).withColumnsRenamed({"up": "cluster"})
    # a vertex leaves at the first merge above it that is large
    small = kids.where(F.col("size") < least).select(F.col("child").alias("node"), F.col("parent").alias("up"))
    exits = _jumped(small).where(F.col("node") < n).join(big.select(F.col("node").alias("up"), "density"), "up").select(F.col("node").alias("vertex"), F.col("up").alias("node"), "density")
    # with least = 1 a vertex may be a cluster; the smallest is two here
    exits = stored(exits.join(belongs, "node").select("vertex", "cluster", "density"))
    births = stored(born.join(belongs.select(F.col("node").alias("parent"), F.col("cluster").alias("above")), "parent").select(F.col("child").alias("cluster"), F.col("above").alias("parent"), F.col("density").alias("birth"), "size"))
    every = births.unionByName(big.where(F.col("node") == root).select(F.col("node").alias("cluster"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("birth"), F.lit(n).cast("long").alias("size")))
    mass = exits.groupBy("cluster").agg(F.sum("density").alias("s"), F.count("*").alias("m")).unionByName(births.groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.col("birth") * F.col("size")).alias("s"), F.sum("size").alias("m")))
    mass = mass.groupBy("cluster").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    clusters = stored(every.join(mass, "cluster", "left").select("cluster", "parent", F.coalesce(F.col("s") - F.col("m") * F.col("birth"), F.lit(0.0)).alias("stability")))
    if clusters.count() <= PIECE:
        chosen = _in_one_task(clusters, _chosen, "cluster long, chosen long")
    else:
        chosen = _chosen_by_levels(clusters)
    return exits.join(chosen, "cluster").select("vertex", "chosen")


def clusters(vectors: DataFrame, least: int = 5, samples: int | None = None, vec: str = "vec_id", embedding: str = "embedding", cells: int | None = None) -> DataFrame:
    """(id, cluster) of every usable row: the smallest id of its cluster, null for noise. samples: neighbours of the core distance
    (``least`` by default)."""
    if least < 2:
        raise ValueError("a cluster has two rows at least")
    vectors = stored(vectors.select(vec, embedding).dropDuplicates([vec]))
    sample = ann._sample(vectors, vec, embedding, 1)
    none = F.lit(None).cast("long").alias("cluster")
    if not len(sample):
        return ann._usable(vectors, vec, embedding, 1).select("id", none).limit(0)
    if cells is None:  # rows that lie together are blocks, which most others need not meet
        cells = max(1, round(vectors.count() ** 0.5 / 8))
    centers = ann.fitted(sample, max(1, min(cells, ann.MOST_CELLS, len(sample))))
    rows = stored(ann.assigned(vectors, centers, vec, embedding).drop("far"))
    n = rows.count()
    if n < max(least, 2):
        return rows.select("id", none)
    tree, _ = spanning_tree(rows, centers.shape[1], min(samples or least, n - 1))
    points = stored(numbered(rows.select("id"), [F.col("id").asc()], "v"))
    ordered = numbered(tree, [F.col("w").asc(), F.col("a").asc(), F.col("b").asc()], "r")
    ordered = stored(ordered.join(points.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(points.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b"))
    joined = merges(ordered.select("r", F.col("va").alias("a"), F.col("vb").alias("b")), n).join(ordered.select((F.col("r") + n).alias("node"), "w"), "node")
    labels = stored(points.join(condensed(stored(joined), n, least).withColumnRenamed("vertex", "v"), "v", "left").select("id", "chosen"))
    names = labels.where("chosen is not null").groupBy("chosen").agg(F.min("id").alias("cluster"))
    return labels.join(names, "chosen", "left").select("id", "cluster")
