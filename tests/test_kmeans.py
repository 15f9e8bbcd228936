"""K-means in tasks: first centres, and results that do not hang on how rows are dealt out."""

import numpy as np
from pyspark.sql import functions as F

from notegrove.operators import cluster


def test_clusters_do_not_hang_on_the_layout(spark):
    """The same vectors in 1 and in 7 partitions, with copies, and vectors that are none or not finite, which are left out."""
    rnd = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(900, 8)))]
    rows += [(1000 + i, rows[i][1]) for i in range(100)] + [(2000, None), (2001, [float("nan")] * 8), (2002, [float("inf")] * 8), (2003, [None] * 8)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = (sorted(map(tuple, cluster.kmeans(x.repartition(n), least=10).collect())) for n in (1, 7))
    assert a == b and len({c for _, c in a}) > 20 and max(i for i, _ in a) < 2000
    label = dict(a)
    assert all(label.get(i) == label.get(1000 + i) for i in range(100))


def test_first_centres_fall_into_all_blobs(spark):
    """80 far groups of 12: one centre each, as drawing one at a time gives, and all vectors stay."""
    rnd = np.random.default_rng(6)
    middle = rnd.normal(size=(80, 6)) * 1000
    x = spark.createDataFrame([(i, (middle[i % 80] + rnd.normal(size=6) / 100).tolist()) for i in range(960)], "vec_id long, embedding array<double>")
    got = cluster.kmeans(x, least=12).groupBy("cluster").agg(F.countDistinct(F.col("id") % 80).alias("blobs"), F.count("*").alias("n")).collect()
    assert len(got) == 80 and {(r["blobs"], r["n"]) for r in got} == {(1, 12)}


def test_fewer_different_vectors_than_clusters(spark):
    x = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(90)], "vec_id long, embedding array<double>")
    got = cluster.kmeans(x, least=5).groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in got) == [30, 30, 30]
