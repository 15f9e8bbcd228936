"""kd-tree filtering against plain rounds of nearest centroids in Python integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from notegrove.llm import kd_clusters
from notegrove.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import difference


def plain(rows, k, rounds, dimensions, scale=256):
    """rows: (id, vector). (id, cluster, distance, cluster inertia, inertia, centroid hash) of each usable one."""
    kept = []
    for ident, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((ident, [math.floor(scale * x) for x in v]))
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), p) for i, p in kept if i is not None)[:k]
    cs = [p for _, p in seeds]
    if not cs:
        return []
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((dist(p, c), n) for n, c in enumerate(cs)) for _, p in kept]
    for _ in range(rounds):
        near = assign()
        for n in range(len(cs)):
            own = [p for (_, p), (_, m) in zip(kept, near, strict=True) if m == n]
            if own:
                cs[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    by = Counter()
    for d, n in near:
        by[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, n, d, by[n], sum(by.values()), sha[n]) for (i, _), (d, n) in zip(kept, near, strict=True)]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def blobs(rnd, n, dimensions, spread):
    centres = [[rnd.uniform(-1, 1) for _ in range(dimensions)] for _ in range(6)]
    return [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("dimensions,spread,tree", [(2, 0.05, 1024), (3, 0.5, 64), (8, 0.1, 300), (5, 0.0, 40)])
def test_brute_force(spark, monkeypatch, dimensions, spread, tree):
    monkeypatch.setattr(kd_clusters, "TREE_ROWS", tree)
    rows = blobs(random.Random(dimensions), 900, dimensions, spread)
    rows += rows[:50] + [(7, rows[11][1]), (None, rows[0][1])]  # repeated rows, one id of two vectors, a row without id
    rows += [(2000, None), (2001, []), (2002, [0.0] * (dimensions + 1)), (2003, [None] + [0.0] * (dimensions - 1)), (2004, [math.nan] * dimensions), (2005, [math.inf] * dimensions), (2006, [1e30] * dimensions)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = kd_clusters.clustered(df, k=12, rounds=4, dimensions=dimensions)
    same(got.collect(), plain([r for r in rows if r[0] != 2006], 12, 4, dimensions))


def test_large_components(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.uniform(1e5, 5e5) for _ in range(4)]) for i in range(300)]
    got = kd_clusters.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7, rounds=3, dimensions=4)
    same(got.collect(), plain(rows, 7, 3, 4))


def test_fewer_than_centroids_and_clashing_names(spark):
    rows = [(1, [0.5, 0.5], "a", 9), (2, [0.25, 1.0], "b", 8), (2, [0.25, 1.0], "b", 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, Inertia int")
    got = kd_clusters.clustered(df, dimensions=2, keep=("vec_id", "cluster", "Inertia"))
    assert got.columns == ["vec_id", "cluster", "Inertia", "_cluster", "distance", "cluster_inertia", "_inertia", "centroid_sha256"]
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == [(1, "a", 0), (2, "b", 0), (2, "b", 0)]
    assert kd_clusters.clustered(df.where("vec_id > 5"), dimensions=2).count() == 0


def test_whole_nodes_are_assigned_and_ties_stay_exact(spark):
    """Far blobs are assigned a node at a time; of two equal centroids the first takes all."""
    rows = blobs(random.Random(4), 4000, 2, 0.002)
    trees = kd_clusters.kd_trees(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), dimensions=2, scale=4096)
    z = np.array([[0, 0], [0, 0], [4096, 4096], [-4096, 4096], [4096, -4096]], np.int64)
    got = kd_clusters.filtered(trees, z)
    assert (1, kd_clusters.COUNT) not in got
    total = sum(v for (_, part), v in got.items() if part == kd_clusters.COUNT)
    assert total == 4000
    assert sum(v for (_, part), v in got.items() if part == kd_clusters.WHOLE) > 0.9 * total


def test_tree_holds_its_rows():
    rnd = np.random.RandomState(0)
    points = rnd.randint(-50, 50, (777, 3)).astype(np.int32)
    order, nodes = kd_clusters.grown(points)
    assert sorted(order) == list(range(777))
    for n in range(len(nodes["child"])):
        own = points[order[nodes["begin"][n] : nodes["end"][n]]].astype(np.int64)
        assert (own.sum(0) == nodes["sums"][n]).all() and (own**2).sum() == nodes["squares"][n]
        assert (own.min(0) == nodes["low"][n]).all() and (own.max(0) == nodes["high"][n]).all()
        assert nodes["child"][n] >= 0 or len(own) <= kd_clusters.LEAF_ROWS or (own == own[0]).all()


def test_query_against_plain_rounds(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()][:150]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(kd_clusters.clustered(df).collect(), plain(rows, 40, 5, 64))


def test_sql(spark, sf):
    name = "op11_kd_clusters"
    assert difference(spark, sf, name, QUERIES[name], ORACLE_SQL[name]) is None
