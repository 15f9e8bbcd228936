"""Evolving maps: the matching against all matchings, and each event."""

import random

import pytest

from notegrove.operators import evolve


def best_weight(edges):
    """The largest sum of any matching, by trying each cluster's maps in turn."""
    by = {}
    for c, m, w in edges:
        by.setdefault(c, []).append((m, w))
    keys = sorted(by)

    def go(i, used):
        if i == len(keys):
            return 0
        return max([go(i + 1, used), *(w + go(i + 1, used | {m}) for m, w in by[keys[i]] if m not in used)])

    return go(0, frozenset())


def check(spark, edges):
    got = [tuple(r) for r in evolve.matched(spark.createDataFrame(edges, "cluster long, map string, shared long")).collect()]
    assert len({c for c, _, _ in got}) == len(got) == len({m for _, m, _ in got})
    assert set(got) <= set(edges)
    assert sum(w for _, _, w in got) == best_weight(edges)


def test_matching_is_the_best(spark):
    rng = random.Random(5)
    # six blocks without common keys make one problem of a run: each is solved on its own
    edges = [(10 * b + c, f"{b}-{m}", rng.randint(1, 9)) for b in range(6) for c in range(4) for m in range(4) if rng.random() < 0.7]
    got = evolve.matched(spark.createDataFrame(edges, "cluster long, map string, shared long")).collect()
    for b in range(6):
        own = [e for e in edges if e[0] // 10 == b]
        assert sum(r["shared"] for r in got if r["cluster"] // 10 == b) == best_weight(own)
    assert len({r["cluster"] for r in got}) == len(got) == len({r["map"] for r in got})


def test_entangled_clusters_bid(spark):
    check(spark, [(1, "a", 10), (1, "b", 9), (2, "a", 9), (2, "b", 1)])  # greedy would take 10 and 1
    check(spark, [(1, "a", 3), (1, "b", 3), (2, "a", 3), (2, "b", 3), (3, "a", 3), (3, "b", 3)])  # three for two


def test_no_edges(spark):
    assert evolve.matched(spark.createDataFrame([], "cluster long, map string, shared long")).count() == 0


def rows(groups):
    return [(k, i) for k, ids in groups.items() for i in ids]


@pytest.mark.parametrize("empty", [False, True])
def test_events(spark, empty):
    maps = {} if empty else {"A": range(0, 10), "B": range(10, 20), "C": range(20, 26), "D": range(30, 34), "E": range(40, 50)}
    clusters = {1: [*range(0, 9), 100, 101], 2: [*range(10, 26)], 3: range(40, 46), 4: range(46, 50), 5: range(200, 206)}
    twice = rows(clusters) * 2 + [(None, 1), (6, None)]
    out = evolve.evolution(spark.createDataFrame(twice, "cluster long, id long"), spark.createDataFrame(rows(maps) + [("F", None)] * (not empty), "map string, id long"))
    got = {tuple(r)[:3] for r in out.collect()}
    if empty:
        assert got == {(c, None, "new") for c in (1, 2, 3, 4, 5, 6)}
    else:
        assert got == {(1, "A", "continue"), (2, "B", "continue"), (2, "C", "merge"), (3, "E", "continue"), (4, "E", "split"), (5, None, "new"), (6, None, "new"), (None, "D", "idle"), (None, "F", "idle")}
