"""Rank fusion, relevance floor, hydration and the hybrid searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrove.operators import retrieval_index
from notegrove.operators.ann import Index
from notegrove.operators.ann import search as nearest
from notegrove.operators.graph import expand
from notegrove.operators.lexical import bm25
from notegrove.operators.vectors import knn
from notegrove.session import stored

RRF_K = 60


def pool_size(topk: int) -> int:
    return max(3 * topk, 20)


def rrf(vector_hits: DataFrame, bm25_hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Full outer fusion of two rankings: (query_id, id, score, vector_rank, bm25_rank, distance). Ranks are from 1."""
    v = vector_hits.select("query_id", "id", "vector_rank", "distance")
    b = bm25_hits.select("query_id", F.col("doc").alias("id"), "bm25_rank")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return v.join(b, ["query_id", "id"], "full_outer").withColumn("score", part("vector_rank") + part("bm25_rank"))


def fused_order() -> list[Column]:
    return [F.round("score", 9).desc(), F.col("vector_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), F.col("id")]


@dataclass(frozen=True)
class Floor:
    """Relevance floor; the defaults are calibrated for sentence embeddings."""

    enabled: bool = True
    similarity: float = 0.70
    absolute: float = 0.15
    bypass_rank: int | None = 5


def floor_code(floor: Floor, distance: Column, bm25_rank: Column) -> Column:
    sim = 1 - distance / 2
    if not floor.enabled:
        return F.lit("off")
    out = F.when(sim < floor.absolute, "below_absolute")
    if floor.bypass_rank is not None:
        out = out.when(bm25_rank <= floor.bypass_rank, "strong_lexical")
    return out.when(sim >= floor.similarity, "similar").when(sim.isNotNull(), "dissimilar").when(bm25_rank.isNotNull(), "weak_lexical").otherwise("no_signal")


def passes(code: Column) -> Column:
    return code.isin("off", "strong_lexical", "similar", "no_signal")


def hydrated(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """Fills title and document from the base table (id, title, document), once for all hits."""
    fill = notes.select("id", F.col("title").alias("__t"), F.col("document").alias("__d"))
    have = lambda c, x: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(x)) if c in hits.columns else F.col(x)
    return hits.join(fill, "id", "left").withColumn("title", have("title", "__t")).withColumn("document", have("document", "__d")).drop("__t", "__d")


def search(queries: DataFrame, notes: DataFrame, vectors: DataFrame, topk: int = 5, mode: str = "hybrid", floor: Floor | None = None, edges: DataFrame | None = None, hops: int = 1, decay: float = 0.5, most: int = 10, ann: Index | None = None, lexical: str | None = None) -> DataFrame:
    """Hybrid search of a batch of queries (query_id, query_text, vector): one plan answers all. Candidates are the best
    max(topk, 10) before the floor; seeds the first topk that pass it; with edges, their neighbours join with hop >= 1. ann: an index of the vectors, which is searched instead of
    all of them; lexical: the folder of a stored index of the notes (``retrieval_index``), whose terms are read instead of their texts."""
    pool = pool_size(topk)
    v = knn(vectors, queries, pool) if ann is None else nearest(ann, queries.select("query_id", "vector"), pool)
    if mode == "vector":
        b = v.select("query_id", F.col("id").alias("doc"), F.lit(0).alias("bm25_rank")).limit(0)
    elif lexical is not None:
        b = retrieval_index.search(queries.select("query_id", "query_text"), lexical, pool)
    else:
        b = bm25(notes, queries, "id", F.concat_ws(" ", "title", "document"), pool)
    ranked = rrf(v, b).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*fused_order()))).where(F.col("rank") <= max(topk, 10))
    code = floor_code(floor or Floor(), F.col("distance"), F.col("bm25_rank"))
    judged = ranked.withColumn("floor_code", code).where(passes(F.col("floor_code")))
    seeds = judged.withColumn("seed", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("seed") <= topk)
    seeds = stored(seeds)  # few rows, used for the hits and their neighbours
    hits = seeds.select("query_id", "id", "score", F.lit(0).alias("hop"), "vector_rank", "bm25_rank", "floor_code")
    if edges is None:
        return hydrated(hits, notes)
    near = expand(seeds.select("query_id", "id", F.col("score").alias("weight")), edges, hops, decay, most)
    more = near.select("query_id", "id", F.col("weight").alias("score"), "hop", F.lit(None).cast("int").alias("vector_rank"), F.lit(None).cast("int").alias("bm25_rank"), F.lit("graph").alias("floor_code"))
    return hydrated(hits.unionByName(more), notes)


def merge_hits(existing: DataFrame, new: DataFrame, most: int = 24) -> DataFrame:
    """Union by note with the best score; a later hit wins a tie. Frames have (id, score, seq)."""
    every = existing.unionByName(new)
    best = Window.partitionBy("id").orderBy(F.round("score", 9).desc(), F.col("seq").desc())
    one = every.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return one.orderBy(F.round("score", 9).desc(), "id").limit(most)


def boosted(hits: DataFrame, mapped: DataFrame, known: DataFrame) -> DataFrame:
    """Notes that a topic map links score 1 at least, and join if they are known."""
    m = mapped.select("id").distinct().join(known.select("id"), "id", "left_semi").withColumn("linked", F.lit(True))
    return hits.join(m, "id", "full_outer").select("id", F.when(F.col("linked"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(1.0))).otherwise(F.col("score")).alias("score"))
