from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from notegrove.operators import images, review, spread, vectors


def test_heavy_key_is_dealt_out(spark, monkeypatch):
    """As a plain join, but the pairs of one key lie in many tasks."""
    monkeypatch.setattr(spread, "SIDE", 8)
    a = spark.createDataFrame([(None, 0)] + [("x", i) for i in range(100)] + [("y", 7), ("y", 7), ("z", 1)], "k string, a int")
    b = spark.createDataFrame([(None, 0)] + [("x", i) for i in range(90)] + [("y", 3)], "k string, b int")
    got = spread.joined(a, b, "k").withColumn("p", F.spark_partition_id())
    tasks = Counter(r["p"] for r in got.collect())
    assert Counter((r["k"], r["a"], r["b"]) for r in got.collect()) == Counter((r["k"], r["a"], r["b"]) for r in a.join(b, "k").collect())
    assert max(tasks.values()) < 9000 / 10
    assert spread.joined(a, b.limit(0), "k").count() == 0


def test_assets_in_text_once(spark, monkeypatch):
    """A chunk has an asset once, be it by two paths, two sources' rows or repeated ones."""
    monkeypatch.setattr(spread, "SIDE", 2)
    p = [f"90_Assets/img-{i}.png" for i in range(3)]
    text = f"![]({p[0]}) ![]({p[1]}) ![]({p[0]})"
    chunks = spark.createDataFrame([("s", "c1", text), ("s", "c1", text), ("s", "c2", f"x {p[1]} y"), ("t", "c1", text)], "source_id string, chunk_id string, text string")
    assets = spark.createDataFrame([("s", p[0], "a"), ("s", p[1], "a"), ("s", p[0], "a"), ("t", p[0], "b"), ("s", p[2], "d"), ("s", p[1], None), ("s", p[0], None)], "source_id string, path string, asset_id string")
    got = images.assets_in(chunks, assets).collect()
    assert Counter((r["chunk_id"], r["asset_id"]) for r in got) == Counter([("c1", "a"), ("c1", "b"), ("c1", None), ("c2", "a"), ("c2", None)])


def test_images_for_chunks_by_brute_force(spark, monkeypatch):
    """Every fitting pair once a pair of rows, with unknown chapters and pages, and no task with most of them."""
    monkeypatch.setattr(spread, "SIDE", 4)
    row = lambda i: ("s" if i % 5 else None if i % 2 else "t", None if i % 4 == 0 else str(i % 3), None if i % 7 == 0 else i % 6, i // 2)
    schema = "source_id string, chapter_id string, page_in_file int, {} int"
    c, a = [row(i) for i in range(60)], [row(3 * i + 1) for i in range(80)]
    fits = lambda x, y: x[0] is not None and x[0] == y[0] and (None in (x[1], y[1]) or x[1] == y[1]) and (None in (x[2], y[2]) or abs(x[2] - y[2]) <= 1)
    got = review.images_for_chunks(spark.createDataFrame(c, schema.format("chunk_id")), spark.createDataFrame(a, schema.format("asset_id"))).withColumn("p", F.spark_partition_id()).collect()
    assert Counter((r["chunk_id"], r["asset_id"]) for r in got) == Counter((x[3], y[3]) for x in c for y in a if fits(x, y))
    assert max(Counter(r["p"] for r in got).values()) < len(got) / 5


def test_neighbours_in_bounded_blocks(spark, monkeypatch):
    """A block of queries is cut by what a task holds of the best too; ties, rows met by several queries that leave them out, and
    few rows, as by brute force."""
    rnd = np.random.RandomState(3)
    x = rnd.randint(0, 3, (3000, 2)).astype(float)  # many ties
    asked = [(i, i * 7 % 3000, x[i].tolist()) for i in range(0, 600, 2)] + [(9001, 14, x[5].tolist()), (9002, None, x[5].tolist())]
    q = spark.createDataFrame(asked, "query_id long, exclude long, vector array<double>")
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(5000, [float("nan"), 1.0])], "vec_id long, embedding array<double>").coalesce(2)
    monkeypatch.setattr(vectors, "BEST_BYTES", 16 * 4 * 100)
    assert len(list(vectors._blocks(q.withColumnRenamed("vector", "v"), 4))) == 4
    got: dict = {}
    for r in vectors.knn(v, q, 4).orderBy("query_id", "vector_rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i, out, y in asked:
        d = ((x - y) ** 2).sum(1)
        assert got[i] == [j for j in np.lexsort((np.arange(3000), d)).tolist() if j != out][:4]
