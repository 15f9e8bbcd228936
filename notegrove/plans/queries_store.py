"""Queries over search, graph, store, review and cluster operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from notegrove.functions import text as tx
from notegrove.operators import ann, cluster, dedup, density, evolve, fusion, graph, lexical, memo, retrieval_index, review, store, vectors
from notegrove.plans.queries_text import QUERY_TOKENS_SQL, TOKENS_SQL, norm
from notegrove.session import shared_folder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TYPES = ("supports", "contradicts", "extends", "depends_on", "exemplifies", "related")
FLOOR = fusion.Floor(similarity=0.60)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- inputs ----------------------------------------------------------------------------------------------------


def vector_queries(spark, sf):
    """Every vector whose id is divisible by 20."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit("").alias("query_text"), F.col("embedding").alias("vector"))


def questions(spark, sf):
    """Every benchmark text whose id is divisible by 20, with the vector of that id."""
    b, e = table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    return b.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")).join(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def notes(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("document"))


def edges(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.agg(F.count("*").alias("n"))  # one row
    names = F.array(*map(F.lit, TYPES))
    return e.crossJoin(F.broadcast(n)).select(F.col("vec_id").alias("source"), ((7 * F.col("vec_id") + 3) % F.col("n")).alias("target"), F.element_at(names, (F.col("vec_id") % 6 + 1).cast("int")).alias("relation_type"))


EDGES = "SELECT vec_id AS source, (7 * vec_id + 3) % (SELECT count(*) FROM embeddings) AS target, [" + ", ".join(f"'{t}'" for t in TYPES) + "][vec_id % 6 + 1] AS relation_type FROM embeddings"
WEIGHT = "CASE {r} WHEN 'contradicts' THEN 1.0 WHEN 'extends' THEN 0.9 WHEN 'depends_on' THEN 0.9 WHEN 'supports' THEN 0.8 WHEN 'exemplifies' THEN 0.7 ELSE 0.5 END::DOUBLE"


def bm25_sql(k: int, text: str = "concat_ws(' ', source, text)") -> str:
    return f"""
q AS (SELECT item_id AS query_id, text AS query_text FROM benchmark WHERE item_id % 20 = 0),
qt AS (SELECT query_id, unnest(list_distinct(list_transform({QUERY_TOKENS_SQL.format(x="query_text")}, lambda t: strip_accents(t)))) AS term FROM q),
tk AS (SELECT doc_id AS doc, {TOKENS_SQL.format(x=f"strip_accents(lower({text}))")} AS t FROM documents),
tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
tf AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), tot GROUP BY query_id, doc),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS bm25_rank FROM sc) WHERE bm25_rank <= {k})"""


def knn_sql(k: int, name: str = "vk", whole: bool = False) -> str:
    asked = "" if whole else " AND a.vec_id IN (SELECT item_id FROM benchmark)"
    return f"""
{name} AS (SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS vector_rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0{asked})) WHERE vector_rank <= {k})"""


RRF = "fu AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.id, b.doc) AS id, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS score, vector_rank, bm25_rank, distance FROM vk v FULL JOIN bm b ON v.query_id = b.query_id AND v.id = b.doc)"
ORDER = "round(score, 9) DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, id"


def code_sql() -> str:
    return "CASE WHEN 1 - distance / 2 < 0.15 THEN 'below_absolute' WHEN bm25_rank <= 5 THEN 'strong_lexical' WHEN 1 - distance / 2 >= 0.6 THEN 'similar' WHEN distance IS NOT NULL THEN 'dissimilar' WHEN bm25_rank IS NOT NULL THEN 'weak_lexical' ELSE 'no_signal' END"


def search_sql(topk: int) -> str:
    pool = fusion.pool_size(topk)
    return f"""WITH {bm25_sql(pool)}, {knn_sql(pool)}, {RRF},
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM fu) WHERE rank <= {max(topk, 10)}),
fl AS (SELECT *, {code_sql()} AS floor_code FROM rk),
sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seed FROM fl WHERE floor_code IN ('strong_lexical', 'similar', 'no_signal')) WHERE seed <= {topk})"""


def graph_sql(seeds: str, hops: int, most: int = 10, decay: float = 0.5) -> str:
    """CTEs from seeds (query_id, id, weight) to ex."""
    u = f"ug AS (SELECT source AS a, target AS b, relation_type AS r FROM ({EDGES}) UNION ALL SELECT target, source, relation_type FROM ({EDGES}))"
    out = [f"se AS ({seeds})", u]
    prev, taken = "SELECT query_id, id, max(weight) AS w FROM se GROUP BY query_id, id", "SELECT query_id, id FROM se"
    for h in range(1, hops + 1):
        out.append(f"f{h} AS ({prev})")
        out.append(f"""h{h} AS (SELECT query_id, b AS id, f.w * {WEIGHT.format(r="r")} * {decay ** (h - 1)} AS weight, {h} AS hop, a AS via_from, r AS via_relation FROM f{h} f JOIN ug ON f.id = a
            WHERE (query_id, b) NOT IN (SELECT query_id, id FROM se) QUALIFY row_number() OVER (PARTITION BY query_id, b ORDER BY round(weight, 9) DESC, via_from, via_relation) = 1)""")
        prev = f"SELECT query_id, id, weight AS w FROM h{h} WHERE (query_id, id) NOT IN ({taken})"
        taken += f" UNION ALL SELECT query_id, id FROM h{h}"
    union = " UNION ALL ".join(f"SELECT * FROM h{h}" for h in range(1, hops + 1))
    out.append(f"bx AS (SELECT * FROM ({union}) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round(weight, 9) DESC, hop, via_from, via_relation) = 1)")
    out.append(f"ex AS (SELECT * FROM bx QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, hop, id) <= {most})")
    return ",\n".join(out)


# --- search ----------------------------------------------------------------------------------------------------


@query(f"WITH {bm25_sql(20)} SELECT query_id, doc, round(score, 6) AS score, bm25_rank FROM bm")
def q_bm25_topk(spark, sf):
    b = lexical.bm25(notes(spark, sf), questions(spark, sf).select("query_id", "query_text"), "id", F.concat_ws(" ", "title", "document"), 20)
    return b.select("query_id", "doc", F.round("score", 6).alias("score"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


@query(f"WITH {bm25_sql(20)} SELECT query_id, doc, round(score, 6) AS score, bm25_rank FROM bm")
def q_bm25_indexed(spark, sf):
    """The hits of q_bm25_topk from a stored index: half of the documents, then a change that replaces some and adds the others."""
    d, root, text = notes(spark, sf), f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}", F.concat_ws(" ", "title", "document")
    first = d.where("id % 2 = 0").withColumn("document", F.when(F.col("id") % 8 == 0, F.lit("replaced below")).otherwise(F.col("document")))
    retrieval_index.build(first, root, "id", text)
    retrieval_index.update(d.where("id % 2 <> 0 OR id % 8 = 0"), root, "id", text)
    b = retrieval_index.search(questions(spark, sf).select("query_id", "query_text"), root, 20)
    return b.select("query_id", "doc", F.round("score", 6).alias("score"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


@query(f"WITH {knn_sql(20, whole=True)} SELECT query_id, id, round(distance, 6) AS distance, vector_rank FROM vk")
def q_knn_topk(spark, sf):
    v = vectors.knn(table(spark, sf, "embeddings"), vector_queries(spark, sf).select("query_id", "vector"), 20)
    return v.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("vector_rank").cast("long").alias("vector_rank"))


def _index(spark, sf):
    return ann.build(table(spark, sf, "embeddings"), f"{shared_folder(spark)}/ann-{uuid.uuid4().hex}")


@query(f"WITH {knn_sql(20, whole=True)} SELECT query_id, id, round(distance, 6) AS distance, vector_rank FROM vk")
def q_ann_exact(spark, sf):
    """The neighbours of q_knn_topk, from the cells of an index that may hold one."""
    v = ann.exact(_index(spark, sf), vector_queries(spark, sf).select("query_id", "vector"), 20)
    return v.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("vector_rank").cast("long").alias("vector_rank"))


def _approximate(spark, sf, k=10):
    """(hits, index, recall): the index's k neighbours of each query, and the share of the true ones among them."""
    q, index = vector_queries(spark, sf).select("query_id", "vector"), _index(spark, sf)
    hits = ann.search(index, q, k)
    true = vectors.knn(table(spark, sf, "embeddings"), q, k).select("query_id", "id", F.lit(1.0).alias("true"))
    return hits, index, hits.select("query_id", "id", F.lit(1.0).alias("hit")).join(true, ["query_id", "id"], "right").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"), F.countDistinct("query_id").alias("queries"))


@query()
def q_ann_topk(spark, sf):
    """The index's neighbours, with the recall of the whole set of queries and how many of the cells a query reads."""
    hits, index, recall = _approximate(spark, sf)
    out = hits.select("query_id", "id", F.round("distance", 6).alias("distance"), "vector_rank")
    return out.crossJoin(F.broadcast(recall.select("recall"))).withColumns({"probes": F.lit(index.probes), "cells": F.lit(index.cells)})  # one row


@query("SELECT (SELECT count(*) FROM embeddings) AS stored, count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0")
def q_ann_recall(spark, sf):
    """Whether the index holds all rows and finds nine tenths of the true neighbours."""
    _, index, recall = _approximate(spark, sf)
    return recall.select(F.lit(int(index.sizes.sum())).cast("long").alias("stored"), "queries", (F.col("recall") >= 0.9).alias("recall_reached"))


def _ranked(spark, sf, pool=24):
    q = questions(spark, sf)
    return fusion.rrf(vectors.knn(table(spark, sf, "embeddings"), q, pool), lexical.bm25(notes(spark, sf), q, "id", F.concat_ws(" ", "title", "document"), pool))


@query(f"WITH {bm25_sql(24)}, {knn_sql(24)}, {RRF} SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM fu")
def q_rrf_fusion(spark, sf):
    w = Window.partitionBy("query_id").orderBy(*fusion.fused_order())
    return _ranked(spark, sf).select("query_id", "id", F.round("score", 9).alias("score"), F.row_number().over(w).cast("long").alias("rank"))


@query(f"WITH {bm25_sql(24)}, {knn_sql(24)}, {RRF} SELECT query_id, id, {code_sql()} AS code, {code_sql()} IN ('strong_lexical', 'similar', 'no_signal') AS passed FROM fu")
def q_relevance_floor(spark, sf):
    code = fusion.floor_code(FLOOR, F.col("distance"), F.col("bm25_rank"))
    return _ranked(spark, sf).select("query_id", "id", code.alias("code"), fusion.passes(code).alias("passed"))


@query(search_sql(8) + ",\n" + graph_sql("SELECT query_id, id, score AS weight FROM sd", 1) + """
SELECT query_id, x.id, round(score, 9) AS score, hop::INT AS hop, floor_code, d.source AS title FROM (SELECT query_id, id, score, 0 AS hop, floor_code FROM sd UNION ALL SELECT query_id, id, weight, hop, 'graph' FROM ex) x LEFT JOIN documents d ON d.doc_id = x.id""")
def q_search_notes(spark, sf):
    hits = fusion.search(questions(spark, sf), notes(spark, sf), table(spark, sf, "embeddings"), topk=8, floor=FLOOR, edges=edges(spark, sf))
    return hits.select("query_id", "id", F.round("score", 9).alias("score"), "hop", "floor_code", "title")


@query(f"WITH {bm25_sql(20, 'text')}, {knn_sql(20)}, {RRF} SELECT query_id, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM fu) WHERE rank <= 5")
def q_search_chunks(spark, sf):
    q = questions(spark, sf)
    fused = fusion.rrf(vectors.knn(table(spark, sf, "embeddings"), q, 20), lexical.bm25(table(spark, sf, "documents"), q, "doc_id", F.col("text"), 20))
    w = Window.partitionBy("query_id").orderBy(*fusion.fused_order())
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {knn_sql(24, whole=True)} SELECT query_id, id, round(1.0::DOUBLE / (60 + vector_rank), 9) AS score, CASE WHEN 1 - distance / 2 >= 0.6 THEN 'similar' END AS floor_code FROM vk WHERE vector_rank <= 10 AND 1 - distance / 2 >= 0.6 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vector_rank) <= 8")
def q_vector_only_mode(spark, sf):
    hits = fusion.search(vector_queries(spark, sf), notes(spark, sf), table(spark, sf, "embeddings"), topk=8, mode="vector", floor=FLOOR)
    return hits.select("query_id", "id", F.round("score", 9).alias("score"), "floor_code")


_SEEDS = "SELECT vec_id // 20 % 4 AS query_id, vec_id AS id, (0.5 + (vec_id // 20 % 10) / 20.0)::DOUBLE AS weight FROM embeddings WHERE vec_id % 20 = 0"


def _seeds(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.expr("vec_id div 20 % 4").alias("query_id"), v.alias("id"), F.expr("0.5D + (vec_id div 20 % 10) / 20.0D").alias("weight"))


def _expansion(spark, sf, hops):
    x = graph.expand(_seeds(spark, sf), edges(spark, sf), hops=hops, most=20)
    return x.select("query_id", "id", F.round("weight", 9).alias("weight"), "hop", "via_from", "via_relation")


_EX = "SELECT query_id, id, round(weight, 9) AS weight, hop::INT AS hop, via_from, via_relation FROM ex"


@query(f"WITH {graph_sql(_SEEDS, 1, 20)} {_EX}")
def q_graph_one_hop(spark, sf):
    return _expansion(spark, sf, 1)


@query(f"WITH {graph_sql(_SEEDS, 2, 20)} {_EX}")
def q_graph_two_hop(spark, sf):
    return _expansion(spark, sf, 2)


@query(f"WITH {graph_sql(_SEEDS, 3, 50)} {_EX}")
def q_graph_three_hop(spark, sf):
    return graph.expand(_seeds(spark, sf), edges(spark, sf), hops=3, most=50).select("query_id", "id", F.round("weight", 9).alias("weight"), "hop", "via_from", "via_relation")


@query(search_sql(5) + ",\n" + graph_sql("SELECT query_id, id, score AS weight FROM sd", 2) + " SELECT query_id, id, CASE WHEN hop = 0 THEN 'busca' ELSE via_relation || ' de ' || via_from::VARCHAR END AS origin FROM (SELECT query_id, id, 0 AS hop, NULL AS via_relation, NULL AS via_from FROM sd UNION ALL SELECT query_id, id, hop, via_relation, via_from FROM ex)")
def q_expand_hits(spark, sf):
    hits = fusion.search(questions(spark, sf), notes(spark, sf), table(spark, sf, "embeddings"), topk=5, floor=FLOOR)
    near = graph.expand(hits.select("query_id", "id", F.col("score").alias("weight")), edges(spark, sf), hops=2)
    via = F.array(F.struct(F.col("via_from").cast("string").alias("from"), F.col("via_relation").alias("relation_type")))
    return hits.select("query_id", "id", F.lit("busca").alias("origin")).unionByName(near.select("query_id", "id", tx.origin_label(F.col("hop"), via).alias("origin")))


@query(f"""WITH e AS ({EDGES}), c AS (SELECT vec_id AS source, (5 * vec_id + 1) % 600 AS target FROM embeddings UNION ALL SELECT source, target FROM e)
SELECT min(source) AS source, arg_min(target, source * 1000000 + target) AS target FROM c WHERE source <> target AND (least(source, target), greatest(source, target)) NOT IN (SELECT (least(source, target), greatest(source, target)) FROM e) AND target IN (SELECT vec_id FROM embeddings) GROUP BY least(source, target), greatest(source, target)""")
def q_edge_pairs_new(spark, sf):
    e, v = edges(spark, sf), table(spark, sf, "embeddings")
    c = v.select(F.col("vec_id").alias("source"), ((5 * F.col("vec_id") + 1) % 600).alias("target")).unionByName(e.select("source", "target"))
    return graph.new_pairs(c, e, v.select(F.col("vec_id").alias("id")))


@query(f"WITH e AS ({EDGES}) SELECT target, string_agg('[[PERM-' || source::VARCHAR || ']] (' || CASE relation_type WHEN 'supports' THEN 'suportado por' WHEN 'contradicts' THEN 'contradiz' WHEN 'extends' THEN 'estendido por' WHEN 'depends_on' THEN 'base para' WHEN 'exemplifies' THEN 'exemplificado por' ELSE 'relacionado' END || ')', E'\\n' ORDER BY source, relation_type) AS backlinks FROM e GROUP BY target")
def q_backlinks(spark, sf):
    line = F.concat(F.lit("[[PERM-"), F.col("source").cast("string"), F.lit("]] ("), tx.inverse_relation(F.col("relation_type")), F.lit(")"))
    rows = edges(spark, sf).select("target", F.struct("source", "relation_type", line.alias("line")).alias("s"))
    return rows.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("backlinks"))


@query(f"""WITH {bm25_sql(24)}, {knn_sql(24)}, {RRF}, hs AS (SELECT id, score, query_id AS seq FROM fu)
SELECT id, round(score, 9) AS score FROM (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, seq DESC) = 1) ORDER BY round(score, 9) DESC, id LIMIT 24""")
def q_multi_query_merge(spark, sf):
    h = _ranked(spark, sf).select("id", "score", F.col("query_id").alias("seq"))
    return fusion.merge_hits(h.where("seq < 2"), h.where("seq >= 2")).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {knn_sql(10, whole=True)}, h AS (SELECT id, max(1.0::DOUBLE / (60 + vector_rank)) AS score FROM vk GROUP BY id), m AS (SELECT DISTINCT target AS id FROM ({EDGES}) WHERE target IN (SELECT doc_id FROM documents)) SELECT coalesce(h.id, m.id) AS id, round(CASE WHEN m.id IS NOT NULL THEN greatest(coalesce(score, 0), 1.0) ELSE score END, 9) AS score FROM h FULL JOIN m ON h.id = m.id")
def q_map_boost(spark, sf):
    v = vectors.knn(table(spark, sf, "embeddings"), vector_queries(spark, sf), 10)
    h = v.groupBy("id").agg(F.max(1.0 / (60 + F.col("vector_rank"))).alias("score"))
    m = edges(spark, sf).select(F.col("target").alias("id"))
    return fusion.boosted(h, m, notes(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query("""WITH n AS (SELECT doc_id, source, substr(text, 1, 200) AS summary, 'img-' || (doc_id % 13)::VARCHAR AS asset FROM documents JOIN embeddings ON doc_id = vec_id), t AS (SELECT source, asset, count(DISTINCT doc_id) AS n FROM n GROUP BY source, asset)
SELECT doc_id, n.source, summary, n.asset, rank::INT AS rank FROM n JOIN (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, asset) AS rank FROM t) USING (source, asset) WHERE rank <= 3""")
def q_catalog(spark, sf):
    n = table(spark, sf, "documents").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").select("doc_id", "source", F.substring("text", 1, 200).alias("summary"), F.concat(F.lit("img-"), (F.col("doc_id") % 13).cast("string")).alias("asset"))
    t = n.groupBy("source", "asset").agg(F.countDistinct("doc_id").alias("n"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "asset"))).where("rank <= 3").drop("n")
    return n.join(t, ["source", "asset"]).select("doc_id", "source", "summary", "asset", "rank")


# --- duplicates ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, h AS checksum, CASE WHEN doc_id <> f THEN f END AS duplicate_of, c AS copies FROM (SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY text) AS f, count(*) OVER (PARTITION BY text) AS c FROM documents)")
def q_dedup_bytes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return dedup.earliest(d, "checksum", "doc_id").select("doc_id", "checksum", "duplicate_of", "copies")


_SPACED = "CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', '  ') ELSE text END"


@query(f"SELECT doc_id, h AS checksum, CASE WHEN doc_id <> f THEN f END AS duplicate_of FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS f FROM (SELECT doc_id, sha256({norm(_SPACED)}) AS h FROM documents))")
def q_dedup_text(spark, sf):
    spaced = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", F.sha2(tx.normalize(spaced), 256).alias("checksum"))
    return dedup.earliest(d, "checksum", "doc_id").select("doc_id", "checksum", "duplicate_of")


@query(f"SELECT doc_id, CASE WHEN fb < doc_id THEN 'file' WHEN ft < doc_id THEN 'content' ELSE 'new' END AS dup_kind, CASE WHEN fb < doc_id THEN fb WHEN ft < doc_id THEN ft END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY b) AS fb, min(doc_id) OVER (PARTITION BY t) AS ft FROM (SELECT doc_id, sha256({_SPACED}) AS b, sha256({norm(_SPACED)}) AS t FROM documents))")
def q_dedup_cascade(spark, sf):
    spaced = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", F.sha2(spaced, 256).alias("b"), F.sha2(tx.normalize(spaced), 256).alias("t"))
    return dedup.cascade(d, "doc_id", "b", "t").select("doc_id", "dup_kind", "duplicate_of")


@query("""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label AS source, 1 - list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))) / 2 AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT source, round(max(s), 6) AS similarity FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(2 - 2 * s, 9), id) <= 3) WHERE s >= 0.25 GROUP BY source""")
def q_semantic_dup(spark, sf):
    e = table(spark, sf, "embeddings")
    s = dedup.semantic(e, vector_queries(spark, sf).select("query_id", "vector"), e.select(F.col("vec_id").alias("id"), F.col("label").alias("source")), threshold=0.25)
    return s.select("source", F.round("similarity", 6).alias("similarity"))


@query("""WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id FROM l WHERE n <= 5 OR p IN (0, n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5)""")
def q_even_sample(spark, sf):
    return dedup.even_sample(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id")


# --- store -----------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 <> 0 THEN source END AS source, n_chars, 'old' AS origin FROM documents WHERE doc_id % 2 = 0),
i AS (SELECT doc_id, upper(lang) AS lang, CASE WHEN doc_id % 4 <> 0 THEN source || '!' END AS source, 1::BIGINT AS n_chars, 'new' AS origin FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(o.doc_id, i.doc_id) AS doc_id, CASE WHEN i.doc_id IS NOT NULL THEN i.lang ELSE o.lang END AS lang, coalesce(i.source, o.source) AS source, CASE WHEN o.doc_id IS NOT NULL AND i.doc_id IS NOT NULL THEN o.n_chars + i.n_chars WHEN i.doc_id IS NOT NULL THEN i.n_chars ELSE o.n_chars END AS n_chars, CASE WHEN o.doc_id IS NOT NULL THEN o.origin ELSE i.origin END AS origin FROM o FULL JOIN i ON o.doc_id = i.doc_id""")
def q_policy_merge(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    old = d.where("doc_id % 2 = 0").select("doc_id", "lang", F.when(i % 5 != 0, F.col("source")).alias("source"), "n_chars", F.lit("old").alias("origin"))
    new = d.where("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"), F.when(i % 4 != 0, F.concat("source", F.lit("!"))).alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit("new").alias("origin"))
    return store.merge(old, new, ["doc_id"], {"source": "C", "n_chars": "+", "origin": "K"})


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE lang END ELSE lang END AS lang, CASE WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 9 = 0 THEN 'y' END ELSE source END AS source FROM documents""")
def q_partial_update(spark, sf):
    d, i = table(spark, sf, "documents").select("doc_id", "lang", "source"), F.col("doc_id")
    u = d.where("doc_id % 6 = 0").select("doc_id", F.when(i % 4 == 0, "x").alias("lang"), F.when(i % 9 == 0, "y").alias("source"))
    return store.patch(d, u, ["doc_id"], forced=("source",))


@query("SELECT 'orders' AS entity, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def q_cascade_delete(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    left = store.cascade(o, {"lineitem": (l, "l_orderkey", "o_orderkey")}, o.where("o_orderstatus = 'F'"), "o_orderkey")
    return store.entity_counts({"orders": left["parents"], "lineitem": left["lineitem"]})


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def q_existing_ids(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey").distinct().join(table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


@query("SELECT source, sum((doc_id % 7 = 3)::INT)::BIGINT AS missing, sum((doc_id % 7 = 3)::INT) = 0 AS complete FROM documents GROUP BY source")
def q_coverage(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return store.coverage(d, d.where("doc_id % 7 <> 3"), "source", "doc_id")


@query("""SELECT source, is_total::INT AS is_total, calls::BIGINT AS calls, cache_hits::BIGINT AS cache_hits, tokens::BIGINT AS tokens, round(cost, 6) AS cost_usd FROM (
SELECT source, grouping(source) AS is_total, sum((kind = 'llm')::INT) AS calls, sum((kind = 'cache_hit')::INT) AS cache_hits, sum(CASE WHEN kind <> 'cache_hit' THEN tokens ELSE 0 END) AS tokens, sum(CASE WHEN kind <> 'cache_hit' THEN cost ELSE 0 END) AS cost FROM (
 SELECT CASE WHEN user_id % 10 <> 0 THEN user_id END AS source, CASE event_type WHEN 'signup' THEN 'llm' WHEN 'view' THEN 'llm' WHEN 'error' THEN 'cache_hit' ELSE 'embed' END AS kind, event_id % 1000 AS tokens, value / 1e6 AS cost FROM events) GROUP BY ROLLUP (source)) WHERE is_total = 1 OR source IS NOT NULL""")
def q_usage_rollup(spark, sf):
    t = F.col("event_type")
    e = table(spark, sf, "events").select(F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("source"), F.when(t.isin("signup", "view"), "llm").when(t == "error", "cache_hit").otherwise("embed").alias("kind"), (F.col("event_id") % 1000).alias("tokens"), (F.col("value") / 1e6).alias("cost"))
    return store.usage_rollup(e)


_ENTITIES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "orders")


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in _ENTITIES) + " UNION ALL SELECT 'status:' || CASE WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'awaiting_review' ELSE 'approved' END, count(*) FROM labels GROUP BY 1")
def q_entity_stats(spark, sf):
    s = F.when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "awaiting_review").otherwise("approved")
    by = table(spark, sf, "labels").groupBy(F.concat(F.lit("status:"), s).alias("entity")).agg(F.count("*").alias("n"))
    return store.entity_counts({t: table(spark, sf, t) for t in _ENTITIES}).unionByName(by)


@query("SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 'persisted' ELSE CASE WHEN quality = 1 THEN 'awaiting_review' ELSE 'failed' END END AS status FROM labels")
def q_status_transition(spark, sf):
    x = table(spark, sf, "labels").withColumn("status", F.when(F.col("quality") == 1, "awaiting_review").otherwise("failed"))
    return store.transition(x, ["awaiting_review"], "persisted", F.col("toxic") == 1).select("doc_id", "status")


@query("""SELECT c_custkey, (coalesce(CASE WHEN c_custkey % 5 <> 0 THEN 100 * c_custkey END, 0) + coalesce(cents, 0))::BIGINT AS cents, (c_custkey % 3 + coalesce(n, 0))::BIGINT AS n
FROM customer LEFT JOIN (SELECT o_custkey, sum(CASE WHEN o_orderstatus <> 'F' THEN round(100 * o_totalprice)::BIGINT END) AS cents, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def q_counters_added(spark, sf):
    i = F.col("c_custkey")
    held = table(spark, sf, "customer").select("c_custkey", F.when(i % 5 != 0, 100 * i).alias("cents"), (i % 3).alias("n"))
    price = F.when(F.col("o_orderstatus") != "F", F.round(100 * F.col("o_totalprice")).cast("long"))
    return store.added(held, table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), price.alias("cents"), F.lit(1).cast("long").alias("n")), "c_custkey", ["cents", "n"])


# --- review ----------------------------------------------------------------------------------------------------

_CAND = r"SELECT l.doc_id, quality, toxic, (doc_id % 5 + 1)::INT AS relevance, array_to_string(string_split(text, ' ')[1:(doc_id % 9)::INT], ' ') AS thesis, array_to_string(string_split(text, ' ')[1:(doc_id % 25)::INT], ' ') AS definition, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'q' END AS quote FROM labels l JOIN documents USING (doc_id)"


def _candidates(spark, sf):
    i = F.col("doc_id")
    words = F.split("text", " ")
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", "quality", "toxic", (i % 5 + 1).cast("int").alias("relevance"), F.array_join(F.slice(words, F.lit(1), (i % 9).cast("int")), " ").alias("thesis"), F.array_join(F.slice(words, F.lit(1), (i % 25).cast("int")), " ").alias("definition"), F.when(i % 4 == 0, " ").otherwise("q").alias("quote"))


def wc(x: str) -> str:
    return rf"CASE WHEN trim({x}, E' \t\n\r\f' || chr(11)) = '' THEN 0 ELSE len(regexp_split_to_array(trim({x}, E' \t\n\r\f' || chr(11)), '\s+')) END"


@query(f"SELECT doc_id, CASE WHEN quality = 0 THEN 'rejected' WHEN relevance < 3 THEN 'low_relevance' WHEN {wc('thesis')} < 5 THEN 'short_thesis' WHEN {wc('definition')} < 10 THEN 'short_definition' WHEN trim(quote) = '' THEN 'missing_quote' END AS reason FROM ({_CAND})")
def q_candidate_filter(spark, sf):
    c = _candidates(spark, sf)
    status = F.when(F.col("quality") == 0, "rejected").otherwise("new")
    return c.select("doc_id", review.reject_reason(status, F.col("relevance"), F.col("thesis"), F.col("definition"), F.col("quote")).alias("reason"))


@query(f"""SELECT doc_id, round(CASE WHEN quality = 0 THEN 0.1 WHEN doc_id % 6 = 0 THEN least(b, 0.55) ELSE least(1.0, CASE WHEN doc_id % 7 = 0 THEN least(b, 0.45) ELSE b END + relevance / 5 * 0.1 + (doc_id % 3) / 2 * 0.2) END, 3)::DOUBLE AS confidence
FROM (SELECT *, (0.4::DOUBLE + CASE WHEN {wc('definition')} >= 20 THEN 0.15 ELSE 0 END + least(0.15::DOUBLE, (doc_id % 5) * 0.05::DOUBLE)) AS b FROM ({_CAND}))""")
def q_review_confidence(spark, sf):
    i = F.col("doc_id")
    s = review.review_confidence(F.when(F.col("quality") == 0, "rejected").otherwise("new"), F.col("definition"), i % 5, F.when(i % 6 == 0, 0).otherwise(3), F.when(i % 7 == 0, 0).otherwise(2), F.col("relevance"), (i % 3) / 2)
    return _candidates(spark, sf).select("doc_id", s.alias("confidence"))


@query("SELECT decision, count(*) AS n FROM (SELECT CASE WHEN coalesce(CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 100) / 100.0 END, 0) >= 0.85 THEN 'approved' ELSE 'awaiting_review' END AS decision FROM labels) GROUP BY decision")
def q_review_partition(spark, sf):
    c = F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 100) / 100.0)
    return table(spark, sf, "labels").groupBy(review.decision(c).alias("decision")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, round(m, 3)::DOUBLE AS average, CASE WHEN m < 7 THEN 'REJECTED' WHEN v IN ('APPROVED', 'REJECTED') THEN v ELSE 'APPROVED' END AS verdict FROM (SELECT doc_id, (doc_id % 5 + doc_id % 7 + doc_id % 11 + 9) / 4 AS m, upper(CASE doc_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'Rejected' ELSE 'maybe' END) AS v FROM documents)")
def q_judge(spark, sf):
    i = F.col("doc_id")
    avg, verdict = review.judged([(i % 5).cast("double"), (i % 7).cast("double"), (i % 11).cast("double"), F.lit(9.0)], F.lit(None).cast("double"), F.when(i % 3 == 0, "approved").when(i % 3 == 1, "Rejected").otherwise("maybe"))
    return table(spark, sf, "documents").select("doc_id", avg.alias("average"), verdict.alias("verdict"))


@query("""WITH a AS (SELECT n_name AS allowed, n_nationkey AS rank FROM nation), t AS (SELECT DISTINCT CASE WHEN c_nationkey % 3 = 0 THEN lower(substr(n_name, 1, 4)) WHEN c_nationkey % 3 = 1 THEN n_name || ' x' ELSE 'zz' || c_nationkey::VARCHAR END AS topic FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT topic, arg_min(allowed, rank) AS allowed FROM t LEFT JOIN a ON contains(lower(topic), lower(allowed)) OR contains(lower(allowed), lower(topic)) GROUP BY topic""")
def q_topic_match(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("c_nationkey")
    t = table(spark, sf, "customer").join(n, k == F.col("n_nationkey")).select(F.when(k % 3 == 0, F.lower(F.substring("n_name", 1, 4))).when(k % 3 == 1, F.concat("n_name", F.lit(" x"))).otherwise(F.concat(F.lit("zz"), k.cast("string"))).alias("topic")).distinct()
    return review.topic_matches(t, n.select(F.col("n_name").alias("allowed"), F.col("n_nationkey").alias("rank")))


# --- clusters --------------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT source AS cluster, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), n AS (SELECT cluster, term, count(*) AS n FROM t GROUP BY cluster, term)
SELECT cluster, string_agg(term, ' ' ORDER BY term COLLATE "C") AS terms FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) <= 10) GROUP BY cluster""".replace(' COLLATE "C"', ""))
def q_cluster_terms(spark, sf):
    return cluster.terms(table(spark, sf, "documents").select("source", F.col("text").alias("title")), "source", "title")


@query("SELECT label AS cluster, count(*) AS size, sha256(string_agg(vec_id::VARCHAR, '|' ORDER BY vec_id::VARCHAR)) AS signature FROM embeddings GROUP BY label")
def q_cluster_signature(spark, sf):
    return cluster.signatures(table(spark, sf, "embeddings"), "label", "vec_id")


@query("""WITH RECURSIVE d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) <= 5), e AS (SELECT a, b FROM k WHERE 1 - d / 2 >= 0.35 UNION SELECT b, a FROM k WHERE 1 - d / 2 >= 0.35),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(c) AS cluster FROM r GROUP BY id)
SELECT id, cluster FROM m WHERE cluster IN (SELECT cluster FROM m GROUP BY cluster HAVING count(*) >= 3)""")
def q_cluster_components(spark, sf):
    return cluster.density_clusters(table(spark, sf, "embeddings"), k=5, threshold=0.35, least=3)


@query()
def q_density_clusters(spark, sf):
    """Clusters of all vectors by density, noise with a null cluster."""
    return density.clusters(table(spark, sf, "embeddings"), least=3)


@query()
def q_kmeans(spark, sf):
    return cluster.kmeans(table(spark, sf, "embeddings"), least=50)


@query("""WITH n AS (SELECT vec_id AS id, label, label::VARCHAR AS whole, label || '-' || coalesce(lang, '') AS part FROM embeddings JOIN documents ON doc_id = vec_id),
c AS (SELECT DISTINCT id, label, CASE WHEN label % 2 = 0 THEN whole ELSE part END AS cluster, CASE WHEN label % 2 = 0 THEN part ELSE whole END AS map FROM n),
s AS (SELECT label, cluster, map, count(*) AS shared FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY shared DESC, cluster, map) AS r FROM s)
SELECT cluster, map, CASE WHEN r = 1 THEN 'continue' WHEN label % 2 = 0 THEN 'merge' ELSE 'split' END AS event, shared FROM r""")
def q_map_evolution(spark, sf):
    """Maps of parts of even labels that grow together, and of odd labels that fall apart into languages."""
    n = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    whole, part = F.col("label").cast("string"), F.concat_ws("-", "label", F.coalesce("lang", F.lit("")))
    even = F.col("label") % 2 == 0
    return evolve.evolution(n.select(F.when(even, whole).otherwise(part).alias("cluster"), F.col("vec_id").alias("id")), n.select(F.when(even, part).otherwise(whole).alias("map"), F.col("vec_id").alias("id")))


@query("SELECT label, vec_id FROM embeddings WHERE vec_id % 2 = 1")
def q_new_members(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id")
    return cluster.new_members(e, e.where("vec_id % 2 = 0"), ["label", "vec_id"])


# --- memo ------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, sha256('Answer: ' || text) AS call_checksum FROM conversations), k AS (SELECT DISTINCT call_checksum FROM c WHERE conv_id % 2 = 0)
SELECT conv_id, turn, call_checksum, call_checksum IN (SELECT call_checksum FROM k) AS cached FROM c""")
def q_memo_hits(spark, sf):
    c = table(spark, sf, "conversations").withColumn("prompt", memo.filled("Answer: {text}", {"text": F.col("text")})).withColumn("call_checksum", F.sha2("prompt", 256))
    cache = c.where("conv_id % 2 = 0").select("call_checksum", F.lit("known").alias("response")).dropDuplicates(["call_checksum"])
    answers, _ = memo.memoised(c.select("conv_id", "turn", "prompt", "call_checksum"), cache)
    return answers.select("conv_id", "turn", "call_checksum", "cached")
