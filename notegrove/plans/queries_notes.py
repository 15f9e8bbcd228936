"""Queries over notes, images, policies, the vector store and the phases, with their SQL."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from notegrove.functions import biblio, ids
from notegrove.functions import text as tx
from notegrove.operators import chunking, images, index, lexical, memo, notes, policies, review, store
from notegrove.plans import articles, phases, workflows
from notegrove.plans.queries_store import EDGES, edges, questions
from notegrove.plans.queries_store import notes as graph_notes
from notegrove.plans.queries_text import TOKENS_SQL
from notegrove.session import stored, table
from notegrove.sources.files import plan_writes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark, sf):
    return table(spark, sf, "documents")


def key():
    return F.col("doc_id")


# --- listings, policies, ledger --------------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey)::INT AS place FROM orders")
def q_newest_listing(spark, sf):
    return policies.numbered_newest(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderkey", "place")


@query("SELECT w.k AS doc_id, lang, n_chars FROM (SELECT DISTINCT doc_id * 2 AS k FROM labels) w LEFT JOIN documents d ON d.doc_id = w.k")
def q_point_lookup(spark, sf):
    return policies.lookup(documents(spark, sf).select("doc_id", "lang", "n_chars"), table(spark, sf, "labels").select((key() * 2).alias("doc_id")), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR (doc_id // 2) NOT IN (SELECT vec_id FROM embeddings)")
def q_concepts_without_notes(spark, sf):
    c = documents(spark, sf).select("doc_id", F.when(key() % 5 != 0, F.expr("doc_id div 2")).alias("note_id"))
    return policies.without_notes(c, table(spark, sf, "embeddings").select(F.col("vec_id").alias("note_id"))).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE source IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 20")
def q_batch_sample(spark, sf):
    return policies.batch_sample(documents(spark, sf).where("source is not null").select("doc_id", "source", (-F.col("n_chars")).alias("o")), ["o", "doc_id"]).select("doc_id", "source")


@query("""WITH r AS (SELECT conv_id AS run_id, 'running' AS status, 5::BIGINT AS tokens_in FROM (SELECT DISTINCT conv_id FROM conversations)), d AS (SELECT conv_id AS run_id, CASE WHEN max(turn) >= 3 THEN 'finished' ELSE 'failed' END AS status, CASE WHEN conv_id % 4 <> 0 THEN sum(length(text)) END AS tokens_in FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id)
SELECT r.run_id, coalesce(d.status, r.status) AS status, coalesce(d.tokens_in, r.tokens_in)::BIGINT AS tokens_in FROM r LEFT JOIN d ON d.run_id = r.run_id UNION ALL SELECT coalesce(max(run_id), 0) + 1, 'running', NULL FROM r""")
def q_run_ledger(spark, sf):
    c = table(spark, sf, "conversations")
    none = F.lit(None).cast("string")
    runs = c.select(F.col("conv_id").alias("run_id")).distinct().select("run_id", F.lit("running").alias("status"), none.alias("finished_at"), F.lit(5).cast("long").alias("tokens_in"))
    done = c.where("conv_id % 3 <> 0").groupBy(F.col("conv_id").alias("run_id")).agg(F.when(F.max("turn") >= 3, "finished").otherwise("failed").alias("status"), F.sum(F.length("text")).alias("n"))
    done = done.select("run_id", "status", F.lit("now").alias("finished_at"), F.when(F.col("run_id") % 4 != 0, F.col("n")).alias("tokens_in"))
    return policies.start_run(policies.finish_runs(runs, done, ["tokens_in"]), "s", F.lit(None).cast("timestamp")).select("run_id", "status", "tokens_in")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 3)")
def q_duplicate_policy(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("new", "file", "content", "semantic"))), (key() % 4 + 1).cast("int"))
    return policies.after_duplicates(documents(spark, sf).select("doc_id", kind.alias("dup_kind")), policies.duplicate_action(force=True)).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 ELSE 1 END::INT AS start_file, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 1 END::INT AS start_book, CASE WHEN doc_id % 3 = 0 THEN 'heuristic' ELSE 'skipped' END AS confidence, 35 AS sure_file, 10 AS sure_book, 'confirmed' AS sure, 1 AS skip_file FROM documents")
def q_paging_policy(spark, sf):
    found = F.when(key() % 3 == 0, (key() % 50).cast("int"))
    f, b, c = policies.content_paging(found, F.when(found.isNotNull(), 1), interactive=True)
    sf_, sb, sc = policies.content_paging(found, found, start_file=35, start_book=10)
    return documents(spark, sf).select("doc_id", f.alias("start_file"), b.alias("start_book"), c.alias("confidence"), sf_.alias("sure_file"), sb.alias("sure_book"), sc.alias("sure"), policies.content_paging(found, found, interactive=True, skip=True)[0].alias("skip_file"))


def _biblio(spark, sf):
    """Metadata of orders: a seed, and what a model found."""
    k = F.col("o_orderkey")
    seed = F.create_map(F.lit("title"), F.lit("T"), F.lit("year"), F.when(k % 2 == 0, "1999").otherwise(" "), F.lit("institution"), F.lit(None).cast("string"))
    found = F.create_map(F.lit("title"), F.lit(" "), F.lit("institution"), F.when(k % 3 == 0, "Univ"), F.lit("url"), F.lit("u"))
    kind = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "outro").otherwise("relatorio")
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), biblio.merged(seed, found).alias("m"), ((k % 10) / 10).alias("a"), F.when(k % 4 != 0, (k % 7) / 10).alias("b"))


_MERGED = "SELECT o_orderkey AS k, 'T' AS title, CASE WHEN o_orderkey % 2 = 0 THEN '1999' ELSE ' ' END AS year, CASE WHEN o_orderkey % 3 = 0 THEN 'Univ' END AS inst, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'outro' ELSE 'relatorio' END AS kind, greatest(o_orderkey % 10 / 10, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 7 / 10 END, 0)) AS best FROM orders"
_CONF = "CASE WHEN kind IS NULL THEN best WHEN kind = 'relatorio' AND year = '1999' AND inst IS NOT NULL THEN greatest(best, 0.85) ELSE greatest(best, 0.6) END"


@query(f"SELECT k AS o_orderkey, title || ',' || year || ',' || coalesce(inst, '-') || ',u' AS fields, round({_CONF}, 6)::DOUBLE AS confidence, CASE WHEN kind = 'relatorio' AND year = '1999' AND inst IS NOT NULL AND {_CONF} >= 0.7 THEN 'keep' ELSE 'drop' END AS action FROM ({_MERGED})")
def q_biblio_merge(spark, sf):
    m = F.col("m")
    conf = biblio.merged_confidence(F.col("a"), F.col("b"), F.col("kind"), F.map_filter(m, lambda _, v: F.trim(v) != ""))
    shown = F.concat_ws(",", m["title"], m["year"], F.coalesce(m["institution"], F.lit("-")), m["url"])
    return _biblio(spark, sf).select("o_orderkey", shown.alias("fields"), F.round(conf, 6).alias("confidence"), policies.bibliography(F.col("kind"), conf, biblio.filled(m)).alias("action"))


@query(f"SELECT k AS o_orderkey, CASE WHEN k % 2 = 0 THEN 'Chapter' ELSE 'T' END AS title, (1 + (inst IS NOT NULL)::INT)::INT AS n_shown FROM ({_MERGED})")
def q_biblio_projection(spark, sf):
    k, m = F.col("o_orderkey"), F.col("m")
    more = F.map_concat(F.map_filter(m, lambda f, _: f != "title"), F.create_map(F.lit("title"), F.lit(" T "), F.lit("chapter_title"), F.when(k % 2 == 0, "Chapter").otherwise("")))
    return _biblio(spark, sf).select("o_orderkey", biblio.primary(F.lit("capitulo_livro"), more, "title").alias("title"), F.size(biblio.shown_fields(m)).alias("n_shown"))


# --- vector store and index ------------------------------------------------------------------------------------


def _stored_vectors(spark, sf, part, name, model="m"):
    e = table(spark, sf, "embeddings").where(part)
    return e.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit(name), F.col("label").cast("string")).alias("document"), index.metadata({"label": F.col("label"), "tags": (F.array(F.lit("a"), F.col("label").cast("string")), "list"), "none": F.lit(None).cast("string")}).alias("metadata"), "embedding", F.lit("p").alias("provider"), F.lit(model).alias("model"))


@query("""SELECT collection, vec_id::VARCHAR AS id, CASE WHEN collection = 'chunks' AND vec_id % 3 = 0 THEN 'new' ELSE 'old' END || label::VARCHAR AS document, 'a, ' || label::VARCHAR AS tags, 2 AS n_fields FROM embeddings, (VALUES ('chunks'), ('mocs')) c(collection)
WHERE CASE collection WHEN 'chunks' THEN (vec_id % 2 = 0 OR vec_id % 3 = 0) AND vec_id % 5 <> 0 ELSE vec_id % 2 = 0 END""")
def q_vector_upsert(spark, sf):
    none = spark.createDataFrame([], index.SCHEMA)
    held = index.upsert(none, _stored_vectors(spark, sf, "vec_id % 2 = 0", "old"), "chunks")
    held = index.upsert(held, _stored_vectors(spark, sf, "vec_id % 2 = 0", "old"), "mocs")
    held = index.upsert(held, _stored_vectors(spark, sf, "vec_id % 3 = 0", "new"), "chunks")
    held = index.upsert(held, _stored_vectors(spark, sf, "vec_id % 7 = 0", "x"), "sources")
    held = index.removed(index.reset(held, "sources"), table(spark, sf, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").cast("string").alias("id")), "chunks")
    return held.select("collection", "id", "document", F.col("metadata")["tags"].alias("tags"), F.size("metadata").alias("n_fields"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'mocs' ELSE 'both' END AS why FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 1")
def q_reindex(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.when(F.col("vec_id") % 3 != 0, F.lit("text")).alias("document"))
    held = index.upsert(spark.createDataFrame([], index.SCHEMA), _stored_vectors(spark, sf, "vec_id % 2 = 0", "old"), "chunks")
    chunks = index.to_embed(e, held, "chunks", "id").select("id", F.lit(1).alias("c"))
    maps = index.to_embed(e, held, "mocs", "id").select("id", F.lit(1).alias("m"))
    both = chunks.join(maps, "id", "full_outer")
    return both.select(F.col("id").cast("long").alias("id"), F.when(F.col("c").isNull(), "mocs").otherwise("both").alias("why"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 3000) WHEN 1 THEN 'sum' || chr(10) || 'a, b' WHEN 2 THEN substr(text, 1, 1500) END AS body FROM documents")
def q_literature_text(spark, sf):
    k = key() % 4
    body = index.literature_text(F.when(k == 3, "pending").otherwise("persisted"), F.when(k == 0, F.col("text")), F.when(k == 1, "sum").otherwise(" "), F.array(F.lit("a"), F.lit("b")), F.col("text"))
    return documents(spark, sf).select("doc_id", body.alias("body"))


def folded_sql(x: str) -> str:
    return TOKENS_SQL.format(x=f"strip_accents(lower({x}))")


@query(f"""WITH t AS (SELECT item_id, unnest({folded_sql("text")}) AS t FROM benchmark), n AS (SELECT item_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS s, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM n GROUP BY item_id)
SELECT item_id, s::INT AS slot, round(n / norm, 6) AS value FROM n JOIN w USING (item_id)""")
def q_hashed_embedding(spark, sf):
    v = index.hashed_vectors(table(spark, sf, "benchmark"), "item_id", "text")
    return v.select("item_id", F.posexplode("embedding").alias("slot", "value")).where("value > 0").select("item_id", "slot", F.round("value", 6).alias("value"))


@query(f"""WITH d AS (SELECT doc_id, {folded_sql("CASE WHEN doc_id % 3 = 0 THEN 'Ação ' || text ELSE text END")} AS t FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id AS doc, term, count(*) AS tf, any_value(dl)::INT AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY doc_id, term UNION ALL SELECT doc_id, NULL, 1, len(t) FROM d""")
def q_index_refresh(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    first = lexical.backfilled(spark.createDataFrame([], "doc long, term string, tf long, dl int"), d, "doc_id", F.col("text"))
    return lexical.refreshed(first, d.where("doc_id % 3 = 0 and doc_id % 7 <> 0").withColumn("text", F.concat(F.lit("Ação "), "text")), "doc_id", F.col("text"), d.where("doc_id % 7 = 0"))


@query(r"SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def q_fold_diacritics(spark, sf):
    return documents(spark, sf).select("doc_id", tx.fold_diacritics(F.col("text")).alias("folded"))


# --- images ----------------------------------------------------------------------------------------------------

def _image_text(text, *keys):
    return F.concat(text, *[F.concat(F.lit(" ![Imagem]("), images.stored_path(F.md5(k.cast("string")), F.lit(".png")), F.lit(") end")) for k in keys])


def _assets(spark, sf):
    return documents(spark, sf).select(F.col("source").alias("source_id"), key().cast("string").alias("asset_id"), images.stored_path(F.md5((key() % 40).cast("string")), F.lit(".PNG")).alias("path"))


@query("""WITH c AS (SELECT source AS s, doc_id AS chapter, doc_id % 30 AS a, (doc_id + 7) % 30 AS b FROM documents), f AS (SELECT s, k, min(chapter) AS chapter FROM (SELECT s, a AS k, chapter FROM c UNION ALL SELECT s, b, chapter FROM c) GROUP BY s, k)
SELECT doc_id, CASE WHEN f.chapter IS NOT NULL THEN source || '::ch' || lpad(f.chapter::VARCHAR, greatest(3, length(f.chapter::VARCHAR))::INT, '0') END AS chapter_id FROM documents LEFT JOIN f ON f.s = source AND f.k = doc_id % 40""")
def q_image_chapters(spark, sf):
    ch = documents(spark, sf).select(F.col("source").alias("source_id"), key().alias("chapter"), _image_text(F.col("text"), key() % 30, (key() + 7) % 30).alias("text"))
    return images.chapters_of(_assets(spark, sf), ch).select(F.col("asset_id").cast("long").alias("doc_id"), "chapter_id")


@query("SELECT c.doc_id AS chunk_id, a.doc_id AS asset_id FROM documents c JOIN documents a ON a.source = c.source AND c.doc_id % 20 = 0 AND a.doc_id % 40 IN (c.doc_id % 30, (c.doc_id + 7) % 30)")
def q_images_in_text(spark, sf):
    c = documents(spark, sf).where("doc_id % 20 = 0").select(F.col("source").alias("source_id"), key().alias("chunk_id"), _image_text(F.col("text"), key() % 30, (key() + 7) % 30).alias("text"))
    return images.assets_in(c, _assets(spark, sf)).select("chunk_id", F.col("asset_id").cast("long").alias("asset_id"))


@query("""SELECT c.doc_id AS chunk_id, a.doc_id AS asset_id FROM documents c JOIN documents a ON a.source = c.source AND c.doc_id % 20 = 0
WHERE (c.doc_id % 4 = 0 OR a.doc_id % 6 = 0 OR c.doc_id % 4 = a.doc_id % 6) AND (c.doc_id % 3 = 0 OR a.doc_id % 5 = 0 OR abs(c.doc_id % 60 - a.doc_id % 60) <= 1)""")
def q_images_for_chunks(spark, sf):
    d = documents(spark, sf)
    null = lambda ok, x: F.when(ok, x)
    c = d.where("doc_id % 20 = 0").select(F.col("source").alias("source_id"), key().alias("chunk_id"), null(key() % 4 != 0, (key() % 4).cast("string")).alias("chapter_id"), null(key() % 3 != 0, key() % 60).alias("page_in_file"))
    a = d.select(F.col("source").alias("source_id"), key().alias("asset_id"), null(key() % 6 != 0, (key() % 6).cast("string")).alias("chapter_id"), null(key() % 5 != 0, key() % 60).alias("page_in_file"))
    return review.images_for_chunks(c, a)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '![Imagem](90_Assets/img-' || substr(md5((doc_id % 40)::VARCHAR), 1, 16) || '.png)' WHEN doc_id % 4 = 1 THEN '![x](http://h/a.png)' WHEN doc_id % 4 = 2 THEN '![](gone.png)' ELSE '' END || text || CASE WHEN doc_id % 3 = 0 THEN '![Imagem](90_Assets/img-' || substr(md5((doc_id % 40)::VARCHAR), 1, 16) || '.png) t' ELSE '' END AS body,
((doc_id % 4 = 0)::INT + (doc_id % 3 = 0)::INT)::BIGINT AS n_images FROM documents""")
def q_markdown_images(spark, sf):
    k = (key() % 40).cast("string")
    ref = F.concat(F.lit("f/"), k, F.lit(".PNG"))
    head = F.when(key() % 4 == 0, F.concat(F.lit("![a b](./"), ref, F.lit(")"))).when(key() % 4 == 1, "![x](http://h/a.png)").when(key() % 4 == 2, "![](gone.png)").otherwise("")
    d = documents(spark, sf).select("doc_id", F.concat(head, "text", F.when(key() % 3 == 0, F.concat(F.lit("!["), k, F.lit("]("), ref, F.lit(") t"))).otherwise("")).alias("body"), F.lit("/box").alias("folder"))
    files = spark.range(40).select(F.concat(F.lit("/box/f/"), F.col("id").cast("string"), F.lit(".PNG")).alias("path"), F.md5(F.col("id").cast("string")).alias("checksum"), F.lit(".PNG").alias("extension"))
    new, shown = images.rewritten(d, files, "doc_id", "body", "folder")
    return new.select("doc_id", "body").join(shown.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", "body", F.coalesce("n", F.lit(0)).alias("n_images"))


# --- notes -----------------------------------------------------------------------------------------------------

_SLUG = r"rtrim(substr(regexp_replace(regexp_replace(trim(lower({x}), E' \t\n\r\f' || chr(11)), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), 1, 50), '-')"


@query(f"""WITH e AS (SELECT * FROM ({EDGES})), r AS (SELECT vec_id AS source, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS target FROM embeddings WHERE vec_id % 4 = 0), a AS (SELECT source, target, relation_type FROM e UNION ALL SELECT source, target, 'extends' FROM r WHERE (source, target) NOT IN (SELECT source, target FROM e))
SELECT a.source, a.target, relation_type, '[[PERM - ' || a.target::VARCHAR || CASE WHEN d.source IS NOT NULL THEN ' - ' || {_SLUG.format(x="d.source")} ELSE '' END || ']]' AS wiki_link FROM a LEFT JOIN documents d ON d.doc_id = a.target""")
def q_connections(spark, sf):
    e = edges(spark, sf)
    n = table(spark, sf, "embeddings").count()
    v = F.col("vec_id")
    refines = table(spark, sf, "embeddings").where("vec_id % 4 = 0").select(v.alias("source"), ((v + 1) % n).alias("target"))
    every = notes.with_refinements(e.withColumn("description", F.lit("d")), refines)
    titles = documents(spark, sf).select(key().alias("id"), F.col("source").alias("title"))
    return notes.resolved(every, titles).select("source", "target", "relation_type", "wiki_link")


@query(f"""SELECT doc_id, '> **Tese**: ' || text || E'\\n\\n## Definição\\n\\n' || lang || E'\\n\\n' || CASE WHEN doc_id % 2 = 0 THEN E'## Exemplo\\n\\nex\\n\\n' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN E'## Figuras\\n\\n![[p.png]]\\n\\ndesc\\n\\n![[q.png]]\\n\\n' ELSE '' END
|| E'## Fonte\\n\\n- Ref. literatura: lit' || CASE WHEN doc_id % 5 = 0 THEN E'\\n- Localizador: p.3' ELSE '' END || E'\\n' || CASE WHEN doc_id % 7 = 0 THEN E'\\n## Conexões\\n\\n- [[A]] (related) -- why\\n- [[B]] (extends)\\n' ELSE '' END AS permanent,
'# ' || lang || E' — Indice de Literatura\\n\\n← [[SRC - ' || {_SLUG.format(x="lang")} || E']]\\n\\n## Notas de Literatura aprovadas\\n\\n<!-- note:auto-lit-index:start -->\\n' || CASE WHEN doc_id % 2 = 0 THEN E'- [[x]]\\n- [[y]]' ELSE '_Nenhuma nota granular aprovada ainda._' END || E'\\n<!-- note:auto-lit-index:end -->\\n' AS literature_index FROM documents""")
def q_note_bodies(spark, sf):
    opt = lambda n, x: F.when(key() % n == 0, x)
    image = lambda p, d: F.struct(F.lit(p).alias("path"), F.lit(d).cast("string").alias("description"))
    link = lambda w, r, d: F.struct(F.lit(w).alias("wiki_link"), F.lit(r).cast("string").alias("relation_type"), F.lit(d).cast("string").alias("description"))
    none = F.lit(None).cast("string")
    body = notes.permanent_note(F.col("text"), F.col("lang"), none, opt(2, "ex"), F.lit(" "), F.lit("lit"), opt(5, "p.3"), opt(3, F.array(image("p.png", "desc"), image("q.png", None))), opt(7, F.array(link("[[A]]", None, "why"), link("[[B]]", "extends", None))))
    return documents(spark, sf).select("doc_id", body.alias("permanent"), notes.literature_index_note(F.col("lang"), opt(2, F.array(F.lit("[[x]]"), F.lit("[[y]]")))).alias("literature_index"))


@query(f"""WITH h AS (SELECT source AS query_id, target AS id, hop, relation_type FROM (SELECT *, source % 2 AS hop FROM ({EDGES}) WHERE source % 20 = 0 UNION ALL SELECT target, source, relation_type, 1 FROM ({EDGES}) WHERE target % 20 = 0)),
l AS (SELECT query_id, hop, h.id, '- **[[PERM - ' || h.id::VARCHAR || ' - ' || {_SLUG.format(x="coalesce(source, 'Sem titulo')")} || CASE WHEN hop = 0 THEN ']]**: ' ELSE ']]** (relacao: ' || relation_type || ' a partir de [[PERM - ' || query_id::VARCHAR || ']]): ' END || substr(coalesce(text, ''), 1, 150) || '...' AS line FROM h LEFT JOIN documents ON doc_id = h.id)
SELECT query_id, concat_ws(E'\\n\\n', '### Similares por embedding' || E'\\n' || string_agg(line, E'\\n' ORDER BY id, line) FILTER (hop = 0), '### Vizinhas por conexao no grafo' || E'\\n' || string_agg(line, E'\\n' ORDER BY id, line) FILTER (hop = 1)) AS context FROM l GROUP BY query_id""")
def q_rag_context(spark, sf):
    e = edges(spark, sf)
    a = e.where("source % 20 = 0").select(F.col("source").alias("query_id"), F.col("target").alias("id"), (F.col("source") % 2).alias("hop"), "relation_type")
    b = e.where("target % 20 = 0").select(F.col("target").alias("query_id"), F.col("source").alias("id"), F.lit(1).cast("long").alias("hop"), "relation_type")
    h = a.unionByName(b).join(documents(spark, sf).select(key().alias("id"), F.col("source").alias("title"), F.col("text").alias("document")), "id", "left")
    return notes.rag_context(h.withColumns({"via_from": F.col("query_id"), "via_relation": F.col("relation_type"), "rank": F.lit(1)}))


@query("""WITH p AS (SELECT coalesce(source, '-') AS moc_id, doc_id AS seq, ['A', 'B', 'Ignorar', 'New', 'Other'][doc_id % 5 + 1] AS s, doc_id % 97 AS note_id FROM documents), q AS (SELECT moc_id, s, note_id, min(seq) AS seq FROM p WHERE s <> 'Ignorar' GROUP BY ALL),
o AS (SELECT moc_id, s AS title, row_number() OVER (PARTITION BY moc_id ORDER BY min(seq), s) + 1 AS pos, string_agg(note_id::VARCHAR, ',' ORDER BY seq, note_id) AS ids FROM q WHERE s NOT IN ('A', 'B') GROUP BY moc_id, s),
k AS (SELECT moc_id, t.title, t.pos, t.ids || coalesce(',' || (SELECT string_agg(note_id::VARCHAR, ',' ORDER BY seq, note_id) FROM q WHERE q.moc_id = m.moc_id AND q.s = t.title AND NOT list_contains(t.l, note_id)), '') AS ids FROM (SELECT DISTINCT moc_id FROM p) m, (VALUES ('A', 0, '1,2', [1, 2]), ('B', 1, '3', [3])) t(title, pos, ids, l))
SELECT moc_id, pos::INT AS pos, title, ids FROM k UNION ALL SELECT moc_id, pos::INT, title, ids FROM o""")
def q_map_placements(spark, sf):
    d = documents(spark, sf).select(F.coalesce("source", F.lit("-")).alias("moc_id"), key().alias("seq"), F.element_at(F.array(*map(F.lit, ("A", "B", "Ignorar", "New", "Other"))), (key() % 5 + 1).cast("int")).alias("subsection"), (key() % 97).alias("note_id"))
    sections = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(t).alias("title"), F.array(*[F.lit(x).cast("long") for x in l]).alias("note_ids")) for i, (t, l) in enumerate((("A", (1, 2)), ("B", (3,))))]))
    maps = d.select("moc_id").distinct().select("moc_id", sections.alias("s")).select("moc_id", "s.*")
    return notes.placed(maps, d).select("moc_id", F.col("at").alias("pos"), "title", F.array_join("note_ids", ",").alias("ids"))


@query("""WITH w AS (SELECT doc_id, source FROM documents), m AS (SELECT source, max(doc_id) AS moc_id FROM w WHERE doc_id % 11 <> 0 GROUP BY source)
SELECT w.doc_id, m.moc_id FROM w LEFT JOIN m ON m.source = w.source""")
def q_existing_map(spark, sf):
    d = documents(spark, sf)
    maps = d.where("doc_id % 11 <> 0 and source is not null").select(key().alias("moc_id"), F.upper("source").alias("topic"), F.timestamp_seconds(key()).alias("created_at"))
    # a source's name may be inside another's: the exact one counts here
    names = d.select("source").distinct().where("source is not null")
    got = review.existing_map(names.select(F.concat(F.lit("<"), "source", F.lit(">")).alias("topic")), maps.withColumn("topic", F.concat(F.lit("<"), "topic", F.lit(">"))))
    return d.select("doc_id", F.concat(F.lit("<"), "source", F.lit(">")).alias("topic")).join(got, "topic", "left").select("doc_id", "moc_id")


@query("""WITH x AS (SELECT doc_id AS t, 'q' || (doc_id % 7)::VARCHAR AS a, 'q' || (doc_id % 5)::VARCHAR AS b, 'q' || (doc_id % 3)::VARCHAR AS c, 'q' || (doc_id % 4)::VARCHAR AS topic FROM documents),
l AS (SELECT t, topic, list_distinct([a, b]) AS e, [a, b, c, b || '!'] AS o FROM x), u AS (SELECT t, unnest(CASE WHEN list_contains(o, topic) THEN o ELSE list_concat([topic], o) END) AS query, generate_subscripts(CASE WHEN list_contains(o, topic) THEN o ELSE list_concat([topic], o) END, 1) AS pos, len(e) AS n FROM l),
f AS (SELECT t, query, min(pos) AS pos, any_value(n) AS n FROM u GROUP BY t, query), r AS (SELECT t, query, n, row_number() OVER (PARTITION BY t ORDER BY pos) - 1 AS pos FROM f)
SELECT t AS topic_id, pos::INT AS pos, query FROM r WHERE pos < 3""")
def q_article_queries(spark, sf):
    d = documents(spark, sf)
    q = lambda n, more="": F.concat(F.lit("q"), (key() % n).cast("string"), F.lit(more))
    rows = lambda *cols: d.select(key().alias("topic_id"), F.posexplode(F.array(*cols)).alias("seq", "query"))
    return notes.article_queries(d.select(key().alias("topic_id"), q(4, " ").alias("topic")), rows(q(7, " "), q(5), F.lit(" ")), rows(q(3), q(5, "!")), 3).withColumnRenamed("at", "pos")


def _scripted(prompt: str) -> str:
    """A model of the query: queries, outlines and scores that follow from the prompt's hash."""
    h = int(hashlib.sha256(prompt.encode()).hexdigest()[:8], 16)
    if prompt.startswith("Proponha o esboço"):
        return json.dumps({"title": f"T{h % 97}", "sections": [{"title": f"S{i}"} for i in range(1 + h % 3)]})
    if prompt.startswith("Avalie"):
        return json.dumps({"average": 6 + h % 3, "feedback": f"F{h % 7}"})
    return f"text {h}" if prompt.startswith("Escreva") else "{}"


@query()
def q_article_states(spark, sf):
    """Articles on all texts that are search queries, over all documents, to their ends; each searches with the vector of its id."""
    topics = stored(questions(spark, sf))
    state = articles.start(topics.select(F.col("query_id").alias("topic_id"), F.col("query_text").alias("topic")), "bigint")
    library = {"notes": graph_notes(spark, sf), "vectors": table(spark, sf, "embeddings"), "edges": edges(spark, sf)}
    embed = lambda q: q.join(topics.select(F.col("query_id").alias("topic_id"), "vector"), "topic_id").select("query_id", "vector")
    done, _ = articles.run(state, library, embed, spark.createDataFrame([], "call_checksum string, response string"), _scripted)
    return done.select("topic_id", "ended", "verdict", "average", "iteration", F.size("outline.sections").alias("n_sections"), F.transform("hits", lambda h: h["id"]).alias("note_ids"), F.sha2("body", 256).alias("body_sha256"))


def _cited(spark, sf):
    """Articles of documents, each citing customers in several ways, and customers as sources."""
    c = F.col("c_custkey")
    name = F.concat(F.lit("Ana Sur"), c.cast("string"))
    s = table(spark, sf, "customer").select(c.alias("source_id"), F.when(c % 9 != 0, F.array(name, F.lit("Rui Z"))).alias("authors"), F.when(c % 4 != 0, 1990 + c % 30).alias("year"))
    s = s.withColumn("in_text_cite", biblio.in_text(F.coalesce("authors", F.array().cast("array<string>")), F.col("year"))).withColumn("reference", F.concat(F.when(F.col("source_id") % 2 == 0, "b").otherwise("B"), F.lit("Ana Sur"), F.col("source_id").cast("string")))
    k = F.when(key() % 150 == 0, F.lit(1)).otherwise(key() % 150).cast("string")
    cite = F.when(key() % 3 == 0, F.concat(F.lit("(SUR"), k, F.lit("; Z, "), (1990 + k.cast("int") % 30).cast("string"), F.lit(")"))).when(key() % 3 == 1, F.concat(F.lit("(SUR"), k, F.lit(" et al., p. 3, "), (1990 + k.cast("int") % 30).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("(SUR"), k, F.lit(", 1800)")))
    a = documents(spark, sf).select(key().alias("article_id"), F.when(key() % 13 == 0, " ").otherwise(F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[()\[\]]", ""), F.lit(" "), cite, F.lit(" ![[90_Assets/x"), (key() % 3).cast("string"), F.lit(".png]]"))).alias("body"))
    return a, s


_CITED = "SELECT doc_id, CASE WHEN doc_id % 150 = 0 THEN 1 ELSE doc_id % 150 END AS k FROM documents WHERE doc_id % 13 <> 0"


@query(f"SELECT doc_id AS article_id, c_custkey AS source_id FROM ({_CITED}) JOIN customer ON c_custkey = k WHERE c_custkey % 9 <> 0 AND c_custkey % 4 <> 0 AND doc_id % 3 <> 2")
def q_citation_match(spark, sf):
    a, s = _cited(spark, sf)
    return notes.cited_sources(a.withColumnRenamed("body", "text"), s)


@query(f"""SELECT doc_id AS article_id, 'Corpo do artigo vazio ou sem evidencia.' AS warning FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, 'Embed inexistente: 90_Assets/x2.png' FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 3 = 2
UNION ALL SELECT doc_id, 'Citacao possivelmente orfa: (SUR' || k::VARCHAR || CASE doc_id % 3 WHEN 0 THEN '; Z, ' || (1990 + k % 30)::VARCHAR WHEN 1 THEN ' et al., p. 3, ' || (1990 + k % 30)::VARCHAR ELSE ', 1800' END || '...)' FROM ({_CITED}) WHERE k % 9 = 0 OR k NOT IN (SELECT c_custkey FROM customer)""")
def q_article_warnings(spark, sf):
    a, s = _cited(spark, sf)
    files = spark.createDataFrame([("90_Assets/x0.png",), ("90_Assets/x1.png",)], "path string")
    return notes.article_warnings(a, files, s, workflows.NO_EVIDENCE)


@query("SELECT c_nationkey AS article_id, string_agg('- ' || r, E'\\n' ORDER BY upper(r), r) AS body FROM (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'B' END || 'Ana Sur' || c_custkey::VARCHAR AS r FROM customer) GROUP BY c_nationkey")
def q_reading_list(spark, sf):
    _, s = _cited(spark, sf)
    return notes.reading_list(table(spark, sf, "customer").select(F.col("c_nationkey").alias("article_id"), F.col("c_custkey").alias("source_id")), s)


@query("SELECT doc_id AS query_id, doc_id * 2 AS id, (doc_id % 10)::DOUBLE / 10 AS score, CASE WHEN doc_id % 2 = 0 THEN source END AS title FROM documents")
def q_hit_records(spark, sf):
    h = documents(spark, sf).select(key().alias("query_id"), (key() * 2).alias("id"), ((key() % 10).cast("double") / 10).alias("score"), F.when(key() % 2 == 0, F.col("source")).alias("title"), F.lit(3).alias("vector_rank"))
    return notes.from_record(notes.to_record(h), "id long, score double, title string")


@query("""SELECT user_id AS source_id, round(coalesce(t, 0), 6) AS cost_usd_total, round(coalesce(l, 0), 6) AS cost_usd_llm, round(coalesce(e, 0), 6) AS cost_usd_embedding, coalesce(p, 0)::BIGINT AS tokens_prompt, coalesce(c, 0)::BIGINT AS tokens_completion, coalesce(m, 0)::BIGINT AS tokens_embedding FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (
SELECT user_id, sum(value / 1e6) AS t, sum(value / 1e6) FILTER (k = 'llm') AS l, sum(value / 1e6) FILTER (k <> 'llm') AS e, sum(event_id % 100) FILTER (k = 'llm') AS p, sum(event_id % 10) FILTER (k = 'llm') AS c, sum(event_id % 100) FILTER (k <> 'llm') AS m FROM (SELECT *, CASE event_type WHEN 'view' THEN 'llm' WHEN 'error' THEN 'cache_hit' ELSE 'embed' END AS k FROM events) WHERE k <> 'cache_hit' AND user_id % 3 <> 0 GROUP BY user_id) USING (user_id)""")
def q_cost_writeback(spark, sf):
    e, t = table(spark, sf, "events"), F.col("event_type")
    use = e.where("user_id % 3 <> 0").select(F.col("user_id").alias("source_id"), F.when(t == "view", "llm").when(t == "error", "cache_hit").otherwise("embed").alias("kind"), (F.col("event_id") % 100).alias("tokens_in"), (F.col("event_id") % 10).alias("tokens_out"), (F.col("value") / 1e6).alias("cost_usd"))
    return notes.costs(e.select(F.col("user_id").alias("source_id")).distinct(), use)


# --- phases ----------------------------------------------------------------------------------------------------

EXTRACT = "Extraia conceitos.\n{text}"


def extractor(prompt: str) -> str:
    """A model that depends on the length of its prompt: some answers are no JSON, and some of those can be repaired."""
    n = len(prompt)
    if prompt.startswith("O JSON"):
        return '{"chunk_status": "approved", "summary": "fixed", "key_concepts": [], "candidates": []}' if "even" in prompt else "still no JSON"
    if n % 5 == 0:
        return "broken even" if n % 2 == 0 else "broken odd"
    thesis = " ".join(["word"] * (n % 7))
    c = {"status": "ok", "relevance": n % 5 + 1, "thesis": f"{thesis} {n % 50}", "definition": "a b c d e f g h i j", "anchor_quote": "q" if n % 3 else ""}
    return "```json\n" + json.dumps({"chunk_status": "approved", "summary": "s", "key_concepts": ["k"], "candidates": [c]}) + "\n```"


_EXTRACTED = "SELECT doc_id, source, text, length(text) + 19 AS n FROM documents WHERE text IS NOT NULL"
_KEPT = "n % 5 + 1 >= 3 AND n % 7 + 1 >= 5 AND n % 3 <> 0"


def _extracted(spark, sf):
    c = documents(spark, sf).where("text is not null").select(key().cast("string").alias("chunk_id"), F.coalesce("source", F.lit("-")).alias("source_id"), "text", F.lit("pending").alias("status"))
    return phases.extract(c, spark.createDataFrame([], "call_checksum string, response string"), EXTRACT, extractor)


@query(f"""SELECT doc_id, CASE WHEN n % 5 <> 0 OR n % 2 = 0 THEN 'awaiting_review' ELSE 'failed' END AS status, CASE WHEN n % 5 <> 0 THEN 's' WHEN n % 2 = 0 THEN 'fixed' END AS summary,
CASE WHEN n % 5 <> 0 THEN round(least(1.0, CASE WHEN {_KEPT} THEN 0.45 ELSE 0.45 END + (n % 5 + 1) / 5 * 0.1 + CASE WHEN n % 3 <> 0 THEN 0.2 ELSE 0 END), 3) WHEN n % 2 = 0 THEN 0.4 END::DOUBLE AS review_confidence FROM ({_EXTRACTED})""")
def q_extract_chunks(spark, sf):
    return _extracted(spark, sf)["chunks"].select(F.col("chunk_id").cast("long").alias("doc_id"), "status", "summary", "review_confidence")


@query(f"SELECT doc_id, (n % 5 + 1)::INT AS relevance, repeat('word ', n % 7) || (n % 50)::VARCHAR AS thesis FROM ({_EXTRACTED}) WHERE n % 5 <> 0 AND {_KEPT}")
def q_extract_concepts(spark, sf):
    return _extracted(spark, sf)["concepts"].select(F.col("chunk_id").cast("long").alias("doc_id"), "relevance", "thesis")


@query("""WITH d AS (SELECT a.vec_id AS c, b.vec_id AS n, list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY c ORDER BY round(d, 9), n) = 1),
r AS (SELECT *, CASE WHEN d <= 1.3 THEN ['create_new', 'ignore', 'refine_existing', 'merge', 'create_new'][c // 20 % 5 + 1] ELSE 'create_new' END AS decision FROM t)
SELECT c AS concept_id, n AS nearest, decision, CASE WHEN decision = 'ignore' THEN 'duplicate' ELSE 'approved' END AS status, CASE WHEN decision IN ('refine_existing', 'merge') THEN c + 1 END AS refines FROM r""")
def q_candidate_dedupe(spark, sf):
    e, v = table(spark, sf, "embeddings"), F.col("vec_id")
    decide = e.where("vec_id % 20 = 0").select(v.alias("concept_id"), F.element_at(F.array(*map(F.lit, ("create_new", "ignore", "refine_existing", "merge", "?"))), F.expr("cast(vec_id div 20 % 5 + 1 as int)")).alias("decision"), (v + 1).alias("target_note_id"))
    out = phases.deduplicated(e.where("vec_id % 20 = 0").select(v.alias("concept_id"), F.col("embedding").alias("vector")), e.where("vec_id % 20 <> 0"), 0.35, decide)
    return out.select("concept_id", "nearest", "decision", "status", "refines")


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'awaiting_review' END AS s, text FROM documents), m AS (SELECT *, CASE WHEN s = 'pending' THEN s WHEN doc_id % 5 = 0 THEN 'rejected' WHEN doc_id % 3 = 0 THEN 'persisted' ELSE s END AS t FROM c)
SELECT doc_id, t AS status, CASE WHEN s = t THEN 'awaiting_review' WHEN t = 'persisted' THEN 'extracted' ELSE t END AS concept, CASE WHEN t = 'persisted' THEN doc_id::VARCHAR || E'\\n\\n' || substr(coalesce(text, ''), 1, 3000) END AS literature FROM m""")
def q_review_decisions(spark, sf):
    d = documents(spark, sf)
    chunks = d.select(key().alias("chunk_id"), F.when(key() % 4 == 0, "pending").otherwise("awaiting_review").alias("status"), F.col("text").alias("draft"))
    concepts = d.select(key().alias("chunk_id"), F.lit("awaiting_review").alias("status"))
    got = phases.decided(chunks, concepts, d.where("doc_id % 3 = 0").select(key().alias("chunk_id")), d.where("doc_id % 5 = 0").select(key().alias("chunk_id")))
    out = got["chunks"].select("chunk_id", "status").join(got["concepts"].select("chunk_id", F.col("status").alias("concept")), "chunk_id").join(got["literature"].select(F.col("id").alias("chunk_id"), F.col("document").alias("literature")), "chunk_id", "left")
    return out.select(F.col("chunk_id").alias("doc_id"), "status", "concept", "literature")


@query(f"""WITH e AS (SELECT source, target, relation_type FROM ({EDGES}) WHERE source <> target), r AS (SELECT vec_id AS source, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS target FROM embeddings WHERE vec_id % 4 = 0),
a AS (SELECT source, target, relation_type, 'd' AS why FROM e UNION ALL SELECT source, target, 'extends', 'refines' FROM r WHERE (source, target) NOT IN (SELECT source, target FROM e)),
l AS (SELECT source, string_agg('- [[PERM - ' || target::VARCHAR || CASE WHEN target % 2 = 0 THEN ' - t' || target::VARCHAR ELSE '' END || ']] (' || relation_type || ') -- ' || why, E'\\n' ORDER BY target::VARCHAR, relation_type) AS lines FROM a GROUP BY source)
SELECT vec_id AS note_id, '> **Tese**: th' || E'\\n\\n## Definição\\n\\ndef\\n\\n## Fonte\\n\\n- Ref. literatura: lit\\n- Localizador: p.1\\n' || coalesce(E'\\n## Conexões\\n\\n' || lines || E'\\n', '') AS body, true AS embed, (SELECT count(*) FROM a WHERE a.source = vec_id AND a.target % 2 = 0)::BIGINT AS n_edges FROM embeddings LEFT JOIN l ON l.source = vec_id""")
def q_connect(spark, sf):
    v = F.col("vec_id")
    e = table(spark, sf, "embeddings")
    n = e.count()
    s = lambda c: c.cast("string")
    concepts = e.select(s(v).alias("concept_id"), s(v).alias("note_id"), F.lit("th").alias("thesis"), F.lit("def").alias("definition"), F.lit("p.1").alias("locator"), F.lit("lit").alias("literature_ref"), F.when(v % 4 == 0, s((v + 1) % n)).alias("refines"))
    links = edges(spark, sf).select(s(F.col("source")).alias("concept_id"), s(F.col("target")).alias("target"), "relation_type", F.lit("d").alias("description"))
    titles = e.where("vec_id % 2 = 0").select(s(v).alias("id"), F.concat(F.lit("t"), s(v)).alias("title"))
    got = phases.connect(concepts, links, titles, spark.createDataFrame([], "note_id string, semantic_checksum string"))
    known = got["edges"].groupBy(F.col("source").alias("note_id")).agg(F.count("*").alias("n"))
    return got["notes"].join(known, "note_id", "left").select(F.col("note_id").cast("long").alias("note_id"), "body", "embed", F.coalesce("n", F.lit(0)).alias("n_edges"))


# --- further text and store operators --------------------------------------------------------------------------


@query("SELECT doc_id, text || E'\\n\\n<!-- note:auto-x:start -->\\nnew\\n<!-- note:auto-x:end -->\\n' AS appended, 'new' AS inner_text, trim(text, E' \\t\\n\\r\\f' || chr(11)) AS stripped FROM (SELECT doc_id, rtrim(coalesce(text, ''), E' \\t\\n\\r\\f' || chr(11)) AS text FROM documents)")
def q_managed_blocks(spark, sf):
    text = F.coalesce("text", F.lit(""))
    put = tx.put_block(text, "auto-x", F.lit("old"))
    again = tx.put_block(put, "auto-x", F.lit("new"))
    blank = F.lit(" \t\n\r\f\v")
    return documents(spark, sf).select("doc_id", again.alias("appended"), tx.read_block(again, "auto-x").alias("inner_text"), F.btrim(tx.strip_blocks(again, ("auto-x",)), blank).alias("stripped"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN greatest(0.6, (doc_id % 900) / 1000) WHEN 1 THEN least(60, greatest(0.6, doc_id % 90)) WHEN 2 THEN least(60, greatest(0.6, (doc_id % 3) * 60)) WHEN 3 THEN least(60, pow(2, doc_id % 9)) ELSE least(60, greatest(0.6, 1.5)) END::DOUBLE AS seconds, (len(list_filter(['a', ' b ', '', 'c' || (doc_id % 3)::VARCHAR], lambda x: trim(x) <> '')))::INT AS n_queries, CASE WHEN doc_id % 4 < 2 THEN 'chunk' ELSE 'nota' END || ' ' || (doc_id % 8)::VARCHAR || '/8' AS label FROM documents")
def q_retry_and_labels(spark, sf):
    n = lambda m: (key() % m).cast("string")
    text = F.when(key() % 5 == 0, F.concat(F.lit("Rate limit: try again in "), n(900), F.lit("ms"))).when(key() % 5 == 1, F.concat(F.lit("Retry after "), n(90), F.lit("s"))).when(key() % 5 == 2, F.concat(F.lit("try again in "), n(3), F.lit("m"))).when(key() % 5 == 3, "busy").otherwise("TRY AGAIN IN 1.5")
    q = tx.extra_queries(F.concat(F.lit("a; b \n;c"), n(3)))
    return documents(spark, sf).select("doc_id", tx.retry_after(text, key() % 9).alias("seconds"), F.size(q).alias("n_queries"), tx.progress(F.when(key() % 4 < 2, "chunk").otherwise("nota"), key() % 8, F.lit(8)).alias("label"))


@query("""WITH c AS (SELECT doc_id, doc_id % 60 AS page, CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'persisted' END AS status FROM documents)
SELECT doc_id, CASE WHEN page >= 20 THEN page - 20 + 7 END::INT AS page_in_book FROM c WHERE page >= 20 OR status <> 'pending'""")
def q_set_paging(spark, sf):
    c = documents(spark, sf).select("doc_id", (key() % 60).cast("int").alias("page_in_file"), F.when(key() % 3 == 0, "pending").otherwise("persisted").alias("status"))
    return workflows.set_paging(c, 20, 7).select("doc_id", "page_in_book")


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(substr(text, 1, 200), '\\s+', ' ', 'g')) AS needle, source FROM documents WHERE text IS NOT NULL), p AS (SELECT source, doc_id AS page_no, t FROM d), c AS (SELECT * FROM d WHERE doc_id % 20 = 0 AND length(needle) >= 20),
x AS (SELECT c.doc_id, page_no, contains(p.t, substr(needle, 1, 120)) AS inside, len(list_intersect(string_split(lower(needle), ' '), string_split(lower(p.t), ' '))) AS shared FROM c JOIN p ON p.source = c.source)
SELECT doc_id, coalesce(min(page_no) FILTER (inside), arg_min(page_no, -shared * 1000000000 + page_no)) AS page FROM x WHERE inside OR shared >= 3 GROUP BY doc_id""")
def q_page_by_text(spark, sf):
    d = documents(spark, sf).where("text is not null")
    return chunking.page_by_text(d.where("doc_id % 20 = 0").select("doc_id", "source", "text"), d.select("source", key().alias("page_no"), F.col("text").alias("page_text")), "doc_id")


@query("SELECT source AS source_id, string_agg('- ' || doc_id::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN ' (p.' || (doc_id % 50)::VARCHAR || ')' WHEN doc_id % 3 = 1 THEN ' (p.' || (doc_id % 70)::VARCHAR || ')' ELSE '' END, E'\\n' ORDER BY CASE WHEN doc_id % 4 <> 0 THEN doc_id % 97 ELSE 0 END, doc_id::VARCHAR) AS body FROM documents WHERE doc_id % 5 IN (0, 1) AND source IS NOT NULL GROUP BY source")
def q_literature_index(spark, sf):
    c = documents(spark, sf).where("source is not null").select(F.col("source").alias("source_id"), key().cast("string").alias("chunk_id"), F.element_at(F.array(*map(F.lit, ("approved", "persisted", "pending", "failed", "rejected"))), (key() % 5 + 1).cast("int")).alias("status"), F.when(key() % 4 != 0, key() % 97).alias("chunk_index"), F.when(key() % 3 == 0, key() % 50).alias("page_in_book"), F.when(key() % 3 < 2, key() % 70).alias("page_in_file"))
    return review.literature_index(c)


@query("""WITH s AS (SELECT DISTINCT conv_id % 12 AS section, conv_id + turn AS i FROM conversations), k AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 0), h AS (SELECT section, string_agg(i::VARCHAR, ',' ORDER BY i) AS ids FROM s WHERE i IN (SELECT id FROM k) GROUP BY section)
SELECT s.section, coalesce(h.ids, (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM (SELECT id FROM k ORDER BY id LIMIT 3))) AS notes FROM (SELECT DISTINCT section FROM s) s LEFT JOIN h ON h.section = s.section WHERE s.section < 8""")
def q_outline_notes(spark, sf):
    s = table(spark, sf, "conversations").groupBy((F.col("conv_id") % 12).alias("section")).agg(F.sort_array(F.collect_set(F.col("conv_id") + F.col("turn"))).alias("note_ids"))
    known = table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"))
    return review.sanitized_outline(s, known).select("section", F.array_join("note_ids", ",").alias("notes"))


@query("""WITH o AS (SELECT doc_id, source, doc_id % 6 AS chapter, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents WHERE doc_id % 4 <> 0), m AS (SELECT source, max(i) AS m FROM o GROUP BY source)
SELECT d.doc_id, coalesce(o.i, coalesce(m, -1) + row_number() OVER (PARTITION BY d.source, o.i IS NULL ORDER BY d.doc_id % 6, d.doc_id))::INT AS chunk_index FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN m ON m.source = d.source WHERE d.source IS NOT NULL""")
def q_chunk_index(spark, sf):
    d = documents(spark, sf).where("source is not null")
    c = d.select("source", (key() % 6).cast("int").alias("chapter"), key().cast("int").alias("piece"), key().cast("string").alias("text"))
    ids_ = chunking.chunk_rows(c, "source")
    known = ids_.where("piece % 4 <> 0").select("chunk_id", "source", (F.row_number().over(chunking.Window.partitionBy("source").orderBy("piece")) - 1).alias("chunk_index"))
    return chunking.chunk_rows(c, "source", known).select(F.col("piece").cast("long").alias("doc_id"), "chunk_index")


@query("SELECT CASE WHEN doc_id % 10 < 4 THEN 'kept' WHEN doc_id % 10 < 7 THEN 'removed' ELSE 'added' END AS what, count(*) AS n FROM documents WHERE doc_id % 2 = 0 OR doc_id % 10 < 4 GROUP BY 1")
def q_chunk_persist(spark, sf):
    d = documents(spark, sf).where("doc_id % 2 = 0 or doc_id % 10 < 4").select(F.lit("c").alias("chapter_id"), key().alias("chunk_id"))
    kept, added, removed = chunking.persisted(d.where("chunk_id % 10 < 7"), d.where("chunk_id % 10 < 4 or chunk_id % 10 >= 7"), "source")
    return kept.select(F.lit("kept").alias("what")).unionByName(removed.select(F.lit("removed").alias("what"))).unionByName(added.select(F.lit("added").alias("what"))).groupBy("what").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE source IS NULL OR doc_id % 3 <> 0 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 3 <> 0 AND source IS NOT NULL)")
def q_keep_only(spark, sf):
    d = documents(spark, sf).select("source", "doc_id")
    return store.keep_only(d, "source", d.where("doc_id % 3 <> 0 and source is not null"), "doc_id").select("doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'updated' ELSE 'skipped' END AS action FROM documents""")
def q_sync_manual(spark, sf):
    d = documents(spark, sf).select("doc_id", key().cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    known = d.where("doc_id % 4 <> 0").select("path", F.concat(F.lit("n"), "path").alias("note_id"), F.sha2(tx.embeddable(F.when(key() % 3 == 0, F.concat("body", F.lit(" more"))).otherwise(F.concat("body", F.lit("  \n\n")))), 256).alias("semantic_checksum"))
    return workflows.sync_manual(d.select("path", "body"), known).select(F.col("path").cast("long").alias("doc_id"), "action")


@query("SELECT CASE WHEN text IS NULL THEN 'no_body' WHEN doc_id % 2 = 0 THEN 'write' WHEN doc_id % 5 <> 0 THEN 'overwrite' ELSE 'keep' END AS action, count(*) AS n FROM documents GROUP BY 1")
def q_rebuild_plan(spark, sf):
    d = documents(spark, sf).select(key().cast("string").alias("path"), key().cast("string").alias("note_id"), F.lit("t").alias("title"), F.col("text").alias("body"), F.when(key() % 5 == 0, "manual").otherwise("pipeline").alias("origin"), "doc_id")
    return plan_writes(workflows.rebuilt_notes(d), d.where("doc_id % 2 = 1").select("path"), force=True).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256('p|m|c' || doc_id::VARCHAR) AS embedding_hash, sha256('p|' || doc_id::VARCHAR || '|m|0.2|pt|ctx') AS call_hash, regexp_extract('In ' || (1890 + doc_id % 250)::VARCHAR || ' x', '\\b((?:19|20)\\d\\d)\\b', 1) AS y FROM documents")
def q_composite_hashes(spark, sf):
    s = key().cast("string")
    y = biblio.year_of(F.concat(F.lit("In "), (1890 + key() % 250).cast("string"), F.lit(" x")))
    return documents(spark, sf).select("doc_id", ids.embedding_input_hash(F.lit("p"), F.lit("m"), F.concat(F.lit("c"), s)).alias("embedding_hash"), ids.call_checksum(F.lit("p"), s, F.lit("m"), F.lit(0.2), F.lit("pt"), F.lit("ctx")).alias("call_hash"), F.coalesce(y.cast("string"), F.lit("")).alias("y"))


@query("SELECT conv_id, turn, replace(replace('{a}: {text} {b}', '{a}', role), '{text}', text) AS prompt FROM conversations")
def q_prompt_filled(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", memo.filled("{a}: {text} {b}", {"a": F.col("role"), "text": F.col("text")}).alias("prompt"))
