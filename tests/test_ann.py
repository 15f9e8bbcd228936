"""The inverted-file index against exact neighbours."""

import math
import random

import pytest
from pyspark.sql import functions as F

from notegrove.operators import ann, vectors
from notegrove.operators.fusion import search


def clustered(n=1500, dims=12, seed=3):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(15)]
    return [(i, [x + rnd.gauss(0, 0.15) for x in centres[i % 15 if i % 3 else 0]]) for i in range(n)]  # a third in one blob


@pytest.fixture(scope="module")
def rows():
    return clustered()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    odd = [(None, rows[0][1]), (9001, None), (9002, [1.0]), (9003, [math.nan] * 12)]
    return ann.build(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(5), str(tmp_path_factory.mktemp("ann") / "i"), cells=40)


def queries(spark, rows, every=10):
    return spark.createDataFrame([(i, v, i) for i, v in rows if i % every == 0], "query_id long, vector array<float>, exclude long")


def found(df):
    return {(r["query_id"], r["vector_rank"]): (r["id"], round(r["distance"], 5)) for r in df.collect()}


def test_exact_is_exact(spark, rows, index):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(ann.exact(index, queries(spark, rows), 10)) == found(vectors.knn(v, queries(spark, rows), 10))


def test_recall_and_lists_read(spark, rows, index):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(r["query_id"], r["id"]) for r in vectors.knn(v, queries(spark, rows), 10).collect()}
    got = {(r["query_id"], r["id"]) for r in ann.search(index, queries(spark, rows), 10).collect()}
    assert len(want & got) >= 0.9 * len(want)
    assert index.probes < index.cells
    one = ann.lists(spark, index, [int(index.sizes.argmax())])
    assert all("cell=%d/" % index.sizes.argmax() in f for f in one.inputFiles()) or len(one.select("cell").distinct().collect()) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "PartitionFilters: [cell" in plan


def test_all_rows_are_stored(spark, rows, index):
    assert index.sizes.sum() == len(rows)
    assert found(ann.search(index, queries(spark, rows, 50), 5, probes=index.cells)) == found(ann.exact(index, queries(spark, rows, 50), 5))


def test_append_and_edges(spark, rows, tmp_path):
    half = spark.createDataFrame(rows[:300], "vec_id long, embedding array<double>")
    i = ann.build(half, str(tmp_path / "a"), cells=9)
    i = ann.append(i, spark.createDataFrame([(5000, [9.0] * 12), (5001, rows[0][1])], "vec_id long, embedding array<double>"))
    assert ann.opened(spark, i.root).sizes.sum() == 302
    q = spark.createDataFrame([(1, [9.0] * 12), (2, None), (3, [0.0])], "query_id long, vector array<double>")
    got = ann.exact(i, q, 1).collect()
    assert [(r["query_id"], r["id"], r["distance"]) for r in got] == [(1, 5000, 0.0)]
    empty = ann.build(half.limit(0), str(tmp_path / "e"))
    assert ann.search(empty, q.where("query_id = 3"), 3).count() == 0


def test_hybrid_search_over_the_index(spark, rows, index):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    notes = v.select(F.col("vec_id").alias("id"), F.lit("t").alias("title"), F.concat(F.lit("note "), "vec_id").alias("document"))
    q = queries(spark, rows, 300).drop("exclude").withColumn("query_text", F.lit(""))
    plain, by_index = (search(q, notes, v, topk=3, mode="vector", ann=a).select("query_id", "id").collect() for a in (None, index))
    assert len(set(map(tuple, plain)) & set(map(tuple, by_index))) >= 0.9 * len(plain)
