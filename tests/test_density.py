"""Density clusters against a plain version over all pairs."""

import random

import numpy as np
import pytest

from notegrove.operators import ann, density
from notegrove.plans.registry import QUERIES

ZERO = density.ZERO


def plain(rows, least, samples=None):
    """Kruskal over all pairs in the same order, a dendrogram, its condensed tree and excess of mass, by recursion."""
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    n = len(ids)
    if n < least:
        return dict.fromkeys(ids)
    off = np.ascontiguousarray(x[:, None, :] - x[None])
    d = np.sqrt((off * off).sum(2))
    k = min(samples or least, n - 1)
    core = np.sort(np.where(np.eye(n, dtype=bool), np.inf, d), 1)[:, k - 1]
    w = np.maximum(np.maximum(core[:, None], core), d)
    pairs = sorted((w[i, j], min(ids[i], ids[j]), max(ids[i], ids[j]), i, j) for i in range(n) for j in range(i))
    top, kids, weight, size = list(range(n)), {}, {}, dict.fromkeys(range(n), 1)

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for q, _, _, i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            node = len(top)
            top.append(node)
            top[a] = top[b] = node
            kids[node], weight[node], size[node] = (a, b), q, size[a] + size[b]
    parent, birth, mass, members = {}, {}, {}, {}

    def leaves(node):
        todo, out = [node], []
        while todo:
            v = todo.pop()
            out += [v] if v < n else []
            todo += kids.get(v, ())
        return out

    root = 2 * n - 2
    todo = [(root, root)]
    birth[root], parent[root] = 0.0, None
    while todo:
        node, c = todo.pop()
        lam = 1 / max(weight[node], ZERO)
        large = [v for v in kids[node] if size[v] >= least]
        for v in kids[node]:
            if len(large) == 2:
                parent[v], birth[v] = c, lam
                mass[c] = mass.get(c, 0.0) + (lam - birth[c]) * size[v]
                todo.append((v, v))
            elif v in large:
                todo.append((v, c))
            else:
                mass[c] = mass.get(c, 0.0) + (lam - birth[c]) * size[v]
                members.setdefault(c, []).extend(leaves(v))
    value, own = {}, {}
    for c in sorted(parent):  # children have smaller numbers
        below = sum(value[k] for k in parent if parent[k] == c)
        own[c] = c != root and mass.get(c, 0.0) >= below
        value[c] = max(mass.get(c, 0.0), below)
    out = dict.fromkeys(ids)
    chosen = {}
    for c in sorted(parent, reverse=True):
        above = chosen.get(parent[c])
        chosen[c] = above if above is not None else c if own[c] else None
    group = {}
    for c, vs in members.items():
        if chosen[c] is not None:
            group.setdefault(chosen[c], []).extend(vs)
    for vs in group.values():
        for v in vs:
            out[ids[v]] = min(ids[u] for u in vs)
    return out


def blobs(n, dims, spread, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-3, 3) for _ in range(dims)] for _ in range(5)]
    rows = [(3 * i, [x + rnd.gauss(0, spread) for x in centres[i % 5]]) for i in range(n * 4 // 5)]
    return rows + [(3 * i + 1, [rnd.uniform(-4, 4) for _ in range(dims)]) for i in range(n - len(rows))]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return {r["id"]: r["cluster"] for r in density.clusters(df, **kw).collect()}


def test_blobs_and_noise(spark):
    rows = blobs(300, 3, 0.15)
    got = run(spark, rows, least=8, cells=6)
    assert got == plain(rows, 8)
    assert 4 <= len({c for c in got.values() if c is not None}) <= 6 and None in got.values()


def test_ties_and_copies_in_small_pieces(spark, monkeypatch):
    """Equal distances and equal vectors; pieces of thirteen edges, and clusters settled level by level."""
    monkeypatch.setattr(density, "PIECE", 13)
    monkeypatch.setattr(density, "LISTED", 1)
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(0, 9)), float(rnd.randint(0, 5))]) for i in range(24)]
    assert run(spark, rows, least=3, samples=2, cells=2) == plain(rows, 3, 2)


def test_edges(spark):
    assert run(spark, [(1, [0.0]), (2, [1.0])], least=3) == {1: None, 2: None}
    rows = [(i, [0.0, 1.0]) for i in range(6)]
    assert run(spark, [*rows, (3, [0.0, 1.0]), (None, [0.0, 0.0]), (9, None)], least=3, cells=2) == plain(rows, 3)
    with pytest.raises(ValueError, match="two rows"):
        run(spark, rows, least=1)


def test_given_vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    got = {r["id"]: r["cluster"] for r in QUERIES["q_density_clusters"](spark, sf).collect()}
    assert got == plain(rows, 3) and any(c is not None for c in got.values())


def test_rows_are_not_copied_to_cells(spark, monkeypatch):
    """Blocks meet in tasks, not as a row of a shuffle for every cell; of equal vectors one is searched for, and no more rows than must be."""

    def stop(*_, **__):
        raise AssertionError("each row goes to every cell")

    asked, outside = [], density._outside
    monkeypatch.setattr(ann, "probed", stop)
    monkeypatch.setattr(density, "_outside", lambda rows, n, dims, todo: asked.append(todo.count()) or outside(rows, n, dims, todo))
    monkeypatch.setattr(density, "BLOCK_BYTES", 1024)
    rows = blobs(200, 3, 0.15, seed=4)
    rows += [(10_000 + i, rows[5 + 7 * (i % 3)][1]) for i in range(120)] + [(20_000 + i, rows[40 + i][1]) for i in range(6)]
    assert run(spark, rows, least=4, cells=5) == plain(rows, 4)
    assert asked and sum(asked) < len(rows)


def test_one_vector_many_times(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)]
    assert run(spark, rows, least=3) == plain(rows, 3)
    rows = [(i, [float(i % 2), 2.0]) for i in range(30)]
    assert run(spark, rows, least=3) == plain(rows, 3)
