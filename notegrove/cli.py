"""Commands over a note store: tables below a root folder, published as snapshots (``store.publish``).

``python -m notegrove.cli --root FOLDER COMMAND ...``; each command is a function too, which takes (spark, root, ...) and
returns a frame or counts.
"""

from __future__ import annotations

import argparse
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegrove.config import Config, load
from notegrove.functions import biblio, ids, paging
from notegrove.functions import text as tx
from notegrove.operators import cluster, evolve, index, memo, notes, policies, retrieval_index, review, store
from notegrove.operators.chunking import chapters, chunk_rows, chunks, persisted
from notegrove.operators.vectors import knn
from notegrove.plans import articles as plan
from notegrove.plans import phases, workflows
from notegrove.schemas import KEYS, POLICIES, SCHEMAS, align
from notegrove.session import session, stored
from notegrove.sources import files

EXTRACT = "Extraia os conceitos do trecho em JSON.\n\n{text}"
CONNECT = "Proponha conexões do conceito com as notas, em JSON.\n\n{thesis}\n\n{definition}\n\nNotas:\n{context}"
CONNECTIONS = "connections array<struct<target:string,relation_type:string,description:string>>"
#: Section of a map for notes that nothing else places, and a map's link to a note, with or without its title.
NOTES = "Notas"
MAP_LINK = r"\[\[[A-Z]+\s+-\s+(\S+?)(?:\s+-\s+[^\]]*)?\]\]"
#: Provider and model of the offline vectors.
SPACE = ("offline", "hashed-64")
#: Table, id, title and text of what each collection holds.
INDEXED = {"sources": ("sources", "source_id", "title", "title"), "chunks": ("chunks", "chunk_id", "section_path", "text"), "permanent_notes": ("notes", "note_id", "title", "body"), "mocs": ("mocs", "moc_id", "topic", "body")}
_CACHE = "call_checksum string, response string"


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's present snapshot, or an empty one."""
    if store.published(spark, root, name):
        return store.current(spark, root, name)
    return spark.createDataFrame([], index.SCHEMA if name == "vectors" else _CACHE if name == "answers" else SCHEMAS[name])


def init(spark: SparkSession, root: str, reset: bool = False) -> dict:
    """Publishes empty tables where there are none; with reset, everywhere (older snapshots stay)."""
    made = [n for n in SCHEMAS if reset or not store.published(spark, root, n)]
    for n in made:
        store.publish(spark.createDataFrame([], SCHEMAS[n]), root, n)
    return {"tables": sorted(made)}


def harvest(spark: SparkSession, root: str, inbox: str, cfg: Config | None = None, skip_duplicates: bool = False, force: bool = False, start_file: int | None = None, start_book: int | None = None) -> dict:
    """New Markdown files become sources, chapters and chunks; files whose bytes or text is known do not. A source makes its file
    known and a chapter its chunks, so they are published last and a run that is cut off anywhere can be run again."""
    cfg = cfg or Config()
    action = policies.duplicate_action(skip_duplicates, force, cfg.harvest.duplicate_action)
    found = files.markdown(files.inbox(spark, inbox)).withColumn("text_checksum", F.sha2("body", 256))
    known = read(spark, root, "sources").select(F.col("extraction_checksum").alias("text_checksum"), F.lit(True).alias("__known")).distinct()
    first = found.groupBy("text_checksum").agg(F.min("path").alias("__first"))
    kind = F.when(F.col("__known") | (F.col("path") != F.col("__first")), "content").otherwise("new")
    fresh = policies.after_duplicates(found.join(known, "text_checksum", "left").join(first, "text_checksum").withColumn("dup_kind", kind), action)
    fresh = stored(fresh.withColumn("source_id", F.concat(F.lit("@"), F.substring("file_checksum", 1, 12))))
    start = policies.content_paging(F.lit(None), F.lit(None), start_file=start_file, start_book=start_book)
    row = fresh.select("source_id", F.col("source_id").alias("citekey"), "title", "year", "file_checksum", F.col("text_checksum").alias("extraction_checksum"), F.col("path").alias("origin_path"), F.lit("md").alias("origin_type"), F.lit("harvested").alias("processing_status"), start[0].alias("content_start_file"), start[1].alias("content_start_book"))
    got = workflows.harvest(fresh.select("source_id", F.col("body").alias("text")), read(spark, root, "chapters"), cfg, start_file or 1, start_book or 1)
    out = {"chunks": got["chunks"], "chapters": got["chapters"], "sources": row}
    for name, df in out.items():
        old = read(spark, root, name)
        key = {"sources": ["source_id"], "chapters": ["chapter_id"], "chunks": ["chunk_id"]}[name]
        store.publish(store.merge(old, align(df, SCHEMAS[name]), key, {}), root, name)
    return {n: read(spark, root, n).join(fresh.select("source_id"), "source_id", "left_semi").count() for n in out}


def extract(spark: SparkSession, root: str, model: Callable[[str], str] = memo.stub) -> dict:
    """Pending chunks through the model; what it answers is kept, so a second run asks nothing."""
    got = phases.extract(read(spark, root, "chunks"), read(spark, root, "answers"), EXTRACT, model)
    _answers(got["cache"], root)
    marks = got["chunks"].select("chunk_id", "status", "review_confidence", F.col("summary").alias("summary_json"))
    store.publish(store.patch(read(spark, root, "chunks"), marks, ["chunk_id"]), root, "chunks")
    store.publish(store.merge(read(spark, root, "concepts"), align(got["concepts"], SCHEMAS["concepts"]), ["concept_id"], {"status": "C"}), root, "concepts")
    return {r["status"]: r["count"] for r in marks.groupBy("status").count().collect()}


def review_chunks(spark: SparkSession, root: str, cfg: Config | None = None) -> dict:
    """Approves confident chunks that await review, and with them their concepts."""
    after = workflows.review_chunks(read(spark, root, "chunks"), cfg)
    store.publish(after, root, "chunks")
    done = read(spark, root, "chunks").where("status = 'persisted'").select("chunk_id", F.lit(True).alias("__done"))
    concepts = read(spark, root, "concepts").join(done, "chunk_id", "left")
    store.publish(align(store.transition(concepts, ["awaiting_review"], "extracted", F.coalesce("__done", F.lit(False))), SCHEMAS["concepts"]), root, "concepts")
    return status(spark, root)


def _put(rows: DataFrame, root: str, name: str) -> None:
    """Merges rows into a table by its key and policy."""
    spark = rows.sparkSession
    store.publish(store.merge(read(spark, root, name), align(rows, SCHEMAS[name]), KEYS[name], POLICIES[name]), root, name)


def _lexical(spark: SparkSession, root: str) -> str:
    """The folder of the notes' stored retrieval index, which is made from all notes where there is none."""
    at = f"{root}/lexical_notes"
    if not retrieval_index.exists(spark, at):
        retrieval_index.build(_searchable(spark, root)[0], at, "id", F.concat_ws(" ", "title", "document"))
    return at


def _index(rows: DataFrame, root: str) -> None:
    """Changed notes (note_id, ...) into the retrieval index, as the table has them now; an index without one comes with the next search."""
    spark = rows.sparkSession
    if retrieval_index.exists(spark, f"{root}/lexical_notes"):
        changed = _searchable(spark, root)[0].join(rows.select("note_id"), "note_id", "left_semi")
        retrieval_index.update(changed, f"{root}/lexical_notes", "id", F.concat_ws(" ", "title", "document"))


def _embed(rows: DataFrame, root: str, collection: str, reset: bool = False) -> int:
    """Rows (id, title, document) into a collection, with offline vectors; returns their number."""
    spark = rows.sparkSession
    rows = stored(rows.where(F.trim(F.coalesce("document", F.lit(""))) != ""))
    vectors = index.hashed_vectors(rows, "id", "document").withColumn("embedding", F.col("embedding").cast("array<float>"))
    new = rows.join(vectors, "id").select("id", "document", index.metadata({"title": F.col("title")}).alias("metadata"), "embedding", F.lit(SPACE[0]).alias("provider"), F.lit(SPACE[1]).alias("model"))
    old = read(spark, root, "vectors")
    store.publish(index.upsert(index.reset(old, collection) if reset else old, new, collection), root, "vectors")
    return rows.count()


def _answers(new: DataFrame, root: str) -> None:
    spark = new.sparkSession
    store.publish(read(spark, root, "answers").unionByName(new.select("call_checksum", "response")).dropDuplicates(["call_checksum"]), root, "answers")


def _searchable(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, vectors, edges) as searches take them: ids are numbers, 64-bit hashes of the notes' ids."""
    key = lambda c: F.xxhash64(c)
    every = read(spark, root, "notes").select(key("note_id").alias("id"), "note_id", F.coalesce("title", "note_id").alias("title"), F.coalesce("body", F.lit("")).alias("document"))
    vectors = index.export(read(spark, root, "vectors"), "permanent_notes").select(key("id").alias("vec_id"), "embedding")
    edges = read(spark, root, "note_connections").select(key("source_note_id").alias("source"), key("target_note_id").alias("target"), "relation_type")
    return every, vectors, edges


def connect(spark: SparkSession, root: str, cfg: Config | None = None, model: Callable[[str], str] = memo.stub, decide: DataFrame | None = None) -> dict:
    """Approved concepts without a note become permanent notes, linked as the model proposes among the nearest stored notes. decide:
    (concept_id, decision, target_note_id) for concepts near a note. Ids follow from the concept and concepts are marked last, so
    a run that is cut off can be run again."""
    cfg = cfg or Config()
    part = F.from_json("candidate_json", "thesis string, definition string")
    todo = read(spark, root, "concepts").where("status = 'extracted' and note_id is null").select("concept_id", "source_id", "chunk_id", part["thesis"].alias("thesis"), part["definition"].alias("definition"))
    todo = stored(todo.where("thesis is not null").join(read(spark, root, "chunks").select("chunk_id", "locator"), "chunk_id", "left").withColumn("query_id", F.xxhash64("concept_id")))
    every, vectors, _ = _searchable(spark, root)
    asked = stored(index.hashed_vectors(todo.withColumn("t", F.concat_ws("\n", "thesis", "definition")), "query_id", "t").withColumnRenamed("embedding", "vector"))
    if decide is None:
        decide = spark.createDataFrame([], "concept_id string, decision string, target_note_id string")
    judged = phases.deduplicated(asked.withColumnRenamed("query_id", "concept_id"), vectors, cfg.review.dedupe_threshold, decide.withColumn("concept_id", F.xxhash64("concept_id")))
    own = stored(todo.join(judged.select(F.col("concept_id").alias("query_id"), "status", "refines"), "query_id"))
    fit = own.where("status = 'approved'")
    near = knn(vectors, asked, cfg.answer.topk_link).join(every.select("id", "note_id", "title"), "id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("vector_rank", "note_id", "title"))), lambda s: F.concat(F.lit("- "), s["note_id"], F.lit(": "), s["title"]))  # topk_link a concept
    calls = fit.join(near.groupBy("query_id").agg(F.array_join(lines, "\n").alias("context")), "query_id", "left")
    calls = calls.withColumn("prompt", memo.filled(CONNECT, {c: F.col(c) for c in ("thesis", "definition", "context")})).withColumn("call_checksum", F.sha2("prompt", 256))
    got, new = phases.answered(calls.select("concept_id", "call_checksum", "prompt"), read(spark, root, "answers"), model, CONNECTIONS, "connections")
    links = got.select("concept_id", F.explode("answer.connections").alias("c")).select("concept_id", "c.*").where("target is not null")
    none = F.lit(None).cast("string")
    rows = fit.select("concept_id", none.alias("note_id"), "thesis", "definition", "locator", notes.wiki_link(F.col("chunk_id"), none, "LIT").alias("literature_ref"), "refines")
    out = phases.connect(rows, links, every.select(F.col("note_id").alias("id"), "title"), read(spark, root, "notes").select("note_id", "semantic_checksum"))
    made = stored(out["notes"].join(fit.select("concept_id", "source_id", F.col("thesis").alias("title")), "concept_id"))
    said = links.join(made.select("concept_id", F.col("note_id").alias("source")), "concept_id").groupBy("source", "target", "relation_type").agg(F.min("description").alias("description"), F.lit(True).alias("said"))
    edges = stored(out["edges"].join(said, ["source", "target", "relation_type"], "left").withColumn("description", F.when(F.col("said"), F.col("description")).otherwise("refines")))
    path = F.concat(F.lit(f"{files.FOLDERS['permanent']}/PERM - "), "note_id", F.lit(".md"))
    now = F.current_timestamp()
    _answers(new, root)
    _put(made.withColumns({"path": path, "origin": F.lit("auto"), "embedding_model": F.lit("/".join(SPACE)), "created_at": now, "updated_at": now}), root, "notes")
    _index(made, root)
    _put(edges.select(F.col("source").alias("source_note_id"), F.col("target").alias("target_note_id"), "relation_type", "description", now.alias("created_at")), root, "note_connections")
    embedded = _embed(made.where("embed").select(F.col("note_id").alias("id"), "title", F.col("body").alias("document")), root, "permanent_notes")
    marks = own.join(made.select("concept_id", "note_id"), "concept_id", "left").select("concept_id", "note_id", F.when(F.col("status") == "approved", "noted").otherwise(F.col("status")).alias("status"))
    store.publish(store.patch(read(spark, root, "concepts"), marks, ["concept_id"]), root, "concepts")
    return {"notes": made.count(), "connections": edges.count(), "embedded": embedded}


def _sections(maps: DataFrame) -> DataFrame:
    """(moc_id, at, title, description, note_ids) of stored maps, as their bodies list them."""
    return maps.where("body is not null").select("moc_id", F.posexplode(tx.map_sections(F.col("body"), MAP_LINK)).alias("at", "s")).select("moc_id", "at", "s.title", "s.description", "s.note_ids")


def _map_bodies(maps: DataFrame, sections: DataFrame, titles: DataFrame) -> DataFrame:
    """(moc_id, body) of maps (moc_id, topic, summary) from sections and titles (note_id, title); a section keeps the order of its notes."""
    rows = sections.select("moc_id", "at", "title", "description", F.posexplode_outer("note_ids").alias("nth", "note_id"))
    named = rows.join(titles.select("note_id", F.col("title").alias("__t")), "note_id", "left").withColumn("link", F.when(F.col("note_id").isNotNull(), notes.wiki_link(F.col("note_id"), F.col("__t"))))
    links = F.transform(F.array_sort(F.collect_list(F.when(F.col("link").isNotNull(), F.struct("nth", "link")))), lambda x: x["link"])  # what one section lists
    one = named.groupBy("moc_id", "at", "title", "description").agg(links.alias("links"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("at", "title", "description", "links"))), lambda x: F.struct(x["title"].alias("title"), x["description"].alias("description"), x["links"].alias("links")))
    return maps.join(one.groupBy("moc_id").agg(body.alias("sections")), "moc_id").select("moc_id", notes.topic_map(F.col("topic"), F.col("summary"), F.col("sections")).alias("body"))


def garden(spark: SparkSession, root: str, cfg: Config | None = None, place: DataFrame | None = None) -> dict:
    """Maps follow the clusters of notes. A cluster goes on with the map that it shares most notes with (``evolve.evolution``), which
    gets the notes that it lacks; a map whose notes went into another's cluster becomes a pointer to that map, if no hand wrote
    it; other clusters get a map of their own, named by their terms. place: (note_id, subsection) of new notes, "ignorar" for
    none; others go to the section of notes."""
    every, vectors, _ = _searchable(spark, root)
    g = (cfg or Config()).garden
    members = stored(cluster.density_clusters(vectors, g.neighbours, g.threshold, g.min_cluster_size).join(every.select("id", "note_id", "title"), "id"))
    found = stored(cluster.signatures(members, "cluster", "id").where(F.col("size") >= g.min_notes).join(cluster.terms(members, "cluster", "title"), "cluster", "left"))
    fit = members.join(found.select("cluster"), "cluster", "left_semi")
    mocs = read(spark, root, "mocs")
    old = stored(_sections(mocs))
    listed = old.select("moc_id", F.explode("note_ids").alias("note_id"))
    events = stored(evolve.evolution(fit.select("cluster", F.col("note_id").alias("id")), listed.select(F.col("moc_id").alias("map"), F.col("note_id").alias("id"))))
    goes = events.where("event = 'continue'").select("cluster", F.col("map").alias("moc_id"))
    hand = F.coalesce(F.col("origin"), F.lit("auto")) == "manual"
    gone = stored(events.where("event = 'merge'").select("cluster", F.col("map").alias("from")).join(goes.withColumnRenamed("moc_id", "into"), "cluster").join(mocs.select(F.col("moc_id").alias("from"), "topic", hand.alias("hand")), "from").where("not hand"))

    # notes that a map lacks: its cluster's, and those of the maps that go into it
    own = goes.join(fit, "cluster").select("moc_id", "note_id").unionByName(gone.join(listed.withColumnRenamed("moc_id", "from"), "from").select(F.col("into").alias("moc_id"), "note_id"))
    lacking = own.distinct().join(listed, ["moc_id", "note_id"], "left_anti")
    if place is None:
        place = spark.createDataFrame([], "note_id string, subsection string")
    put = lacking.join(place.select("note_id", "subsection"), "note_id", "left").withColumn("subsection", F.coalesce("subsection", F.lit(NOTES))).withColumn("seq", F.row_number().over(Window.partitionBy("moc_id").orderBy("note_id")))
    put = stored(put.where(F.lower("subsection") != "ignorar"))
    after = notes.placed(old.join(put.select("moc_id"), "moc_id", "left_semi").select("moc_id", "at", "title", "note_ids"), put)
    after = after.join(old.select("moc_id", "at", F.col("title"), "description"), ["moc_id", "at", "title"], "left").withColumn("description", F.coalesce("description", F.lit("")))
    grown = _map_bodies(mocs.select("moc_id", "topic", tx.map_summary(F.col("body")).alias("summary")), after, every.select("note_id", "title"))
    marks = goes.join(found.select("cluster", "signature"), "cluster").select("moc_id", F.col("signature").alias("cluster_signature"))
    moved = mocs.select("moc_id", "topic", "path", "origin", "cluster_signature", "created_at").join(marks.withColumnRenamed("cluster_signature", "__s"), "moc_id")
    grown = moved.join(grown, "moc_id", "left").where(F.col("body").isNotNull() | ~F.col("cluster_signature").eqNullSafe(F.col("__s"))).withColumn("cluster_signature", F.col("__s")).drop("__s")
    target = mocs.select(F.col("moc_id").alias("into"), F.col("topic").alias("into_topic"))
    pointer = F.concat(F.lit("# "), F.col("topic"), F.lit("\n\n"), notes.wiki_link(F.col("into"), F.col("into_topic"), "MOC"), F.lit("\n"))
    merged = gone.join(target, "into").select(F.col("from").alias("moc_id"), pointer.alias("body"), F.lit("").alias("cluster_signature")).join(mocs.select("moc_id", "topic", "path", "origin", "created_at"), "moc_id")

    fresh = found.join(events.where("event in ('new', 'split')").select("cluster"), "cluster", "left_semi").withColumn("topic", F.coalesce("terms", F.substring("signature", 1, 12)))
    moc = ids.stable_id(F.col("signature"))
    head = fresh.select(moc.alias("moc_id"), "cluster", "topic", F.lit(None).cast("string").alias("summary"), F.col("signature").alias("cluster_signature"))
    lists = head.join(fit, "cluster").groupBy("moc_id").agg(F.array_sort(F.collect_list("note_id")).alias("note_ids")).select("moc_id", F.lit(0).alias("at"), F.lit(NOTES).alias("title"), F.lit("").alias("description"), "note_ids")  # what one map lists
    made = head.join(_map_bodies(head, lists, every.select("note_id", "title")), "moc_id").select("moc_id", "topic", F.concat(F.lit(f"{files.FOLDERS['moc']}/MOC - "), "moc_id", F.lit(".md")).alias("path"), "body", F.lit("auto").alias("origin"), "cluster_signature", F.current_timestamp().alias("created_at"))
    rows = made.unionByName(grown.select(made.columns)).unionByName(merged.select(made.columns))
    rows = stored(rows.withColumn("updated_at", F.current_timestamp()))
    counts = {"maps": made.count(), "grown": put.select("moc_id").distinct().count(), "merged": gone.count()}
    changed = rows.select(F.col("moc_id").alias("id"), F.col("topic").alias("title"), F.col("body").alias("document")).where("document is not null")
    _put(rows, root, "mocs")
    return counts | {"embedded": _embed(changed, root, "mocs")}


def _question(spark: SparkSession, texts: list[str]) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")
    return asked.join(index.hashed_vectors(asked, "query_id", "query_text").withColumnRenamed("embedding", "vector"), "query_id")


def ask(spark: SparkSession, root: str, question: str, cfg: Config | None = None, graph: bool = True, model: Callable[[str], str] = memo.stub, mode: str = "hybrid") -> dict:
    """The answer to a question from the notes, by the stored retrieval index; what the model says is kept. mode: hybrid or vector."""
    every, vectors, edges = _searchable(spark, root)
    got, new = workflows.ask(_question(spark, [question]), every.drop("note_id"), vectors, read(spark, root, "answers"), edges if graph else None, cfg, model=model, names=every, lexical=_lexical(spark, root) if mode == "hybrid" else None, mode=mode)
    row = got.first()
    _answers(new, root)
    return {"answer": row["answer"], "cached": bool(row["cached"])}


def articles(spark: SparkSession, root: str, topics: DataFrame, cfg: Config | None = None, model: Callable[[str], str] = memo.stub, rounds: int = 3, mode: str = "hybrid", looks: DataFrame | None = None, choices: DataFrame | None = None, skip_judge: bool = False) -> DataFrame:
    """Articles on topics (topic_id, topic[, extras, style, personality, outline_only]), all at once, as ``plans.articles`` writes them:
    (topic_id, topic, ended, average, rejections, body, warnings). States and answers are published after every round, so topics
    of a run that was cut off go on with the next call."""
    every, vectors, edges = _searchable(spark, root)
    library = {"notes": every, "vectors": vectors, "edges": edges}
    if mode == "hybrid":
        library["lexical"] = _lexical(spark, root)
    mocs = read(spark, root, "mocs")
    mapped = review.existing_map(topics.select("topic_id", "topic"), mocs).where("moc_id is not null").select("topic_id", "moc_id")
    linked = _sections(mocs).select("moc_id", F.explode("note_ids").alias("note_id"))
    library["boost"] = stored(mapped.join(linked, "moc_id").join(every.select("id", "note_id"), "note_id").select("topic_id", "id").distinct())
    state = plan.start(topics, "bigint")
    if store.published(spark, root, "article_states"):
        live = store.current(spark, root, "article_states").where("node <> 'end'")
        state = state.join(live.select("topic_id"), "topic_id", "left_anti").unionByName(live)

    def keep(now: DataFrame, new: DataFrame | None) -> DataFrame:
        if new is not None:
            _answers(new, root)
        store.publish(now, root, "article_states")
        return store.current(spark, root, "article_states")

    embed = lambda q: index.hashed_vectors(q, "query_id", "query_text").withColumnRenamed("embedding", "vector")
    done, _ = plan.run(state, library, embed, read(spark, root, "answers"), model, cfg, looks, choices, rounds, skip_judge=skip_judge, mode=mode, keep=keep)
    year = F.col("year").cast("string")
    sources = read(spark, root, "sources").select("source_id", "authors", "year", biblio.in_text(F.coalesce("authors", F.array().cast("array<string>")), year).alias("in_text_cite"), F.col("abnt_reference").alias("reference"))
    return plan.report(done, read(spark, root, "assets").select("path"), sources)


def article(spark: SparkSession, root: str, topic: str, extra: list[str] | None = None, cfg: Config | None = None, model: Callable[[str], str] = memo.stub, rounds: int = 3, style: str = "blog", personality: str = "neutral", outline_only: bool = False, mode: str = "hybrid") -> dict:
    """An article on one topic, redrafted until the judge's score is high enough; extra: further queries."""
    one = spark.createDataFrame([(topic, extra or [], style, personality, outline_only)], "topic string, extras array<string>, style string, personality string, outline_only boolean")
    one = one.withColumn("topic_id", F.xxhash64(*one.columns))
    row = articles(spark, root, one, cfg, model, rounds, mode).join(one.select("topic_id"), "topic_id", "left_semi").first()
    return {"body": row["body"], "ended": row["ended"], "score": row["average"], "rejections": row["rejections"], "warnings": row["warnings"]}


def reindex(spark: SparkSession, root: str, collection: str | None = None, force: bool = False) -> dict:
    """Vectors again from the tables, without model calls; force: collections are emptied first."""
    out = {}
    for name in [collection] if collection else INDEXED:
        table, key, title, body = INDEXED[index.known(name)]
        rows = read(spark, root, table).select(F.col(key).alias("id"), F.col(title).alias("title"), F.col(body).alias("document"))
        if name == "permanent_notes" and force:  # the words too
            retrieval_index.build(_searchable(spark, root)[0], f"{root}/lexical_notes", "id", F.concat_ws(" ", "title", "document"))
        out[name] = _embed(index.to_embed(rows, read(spark, root, "vectors"), name, "id", force), root, name, force)
    return out


def _below(path: str, folder: str) -> Column:
    """A file's path below a folder, which may have a scheme."""
    inside = re.escape("/" + re.sub(r"^[a-z0-9]+:", "", folder).strip("/") + "/")
    return F.regexp_replace(path, f"^.*?{inside}", "")


def rebuild(spark: SparkSession, root: str, vault: str, force: bool = False, dry_run: bool = False) -> dict:
    """Writes the files of stored notes and maps that the vault lacks; force: all but manual ones."""
    every = read(spark, root, "notes").unionByName(read(spark, root, "mocs").select(F.col("moc_id").alias("note_id"), F.col("topic").alias("title"), "path", "body", "origin"), allowMissingColumns=True)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(vault)
    plan = files.plan_writes(workflows.rebuilt_notes(every), there.select(_below("path", vault).alias("path")), force)
    done = plan.groupBy("action").agg(F.count("*").alias("n")) if dry_run else files.write_files(plan, vault.removeprefix("file://"))
    return {r["action"]: r["n"] for r in done.collect()}


def sync_manual(spark: SparkSession, root: str, vault: str) -> dict:
    """Notes that were written or changed by hand in the vault go to the store and the index, as manual ones."""
    found = files.markdown(files.inbox(spark, f"{vault}/{files.FOLDERS['permanent']}")).withColumn("path", _below("path", vault))
    acts = stored(workflows.sync_manual(found.select("path", "body"), read(spark, root, "notes").select("path", "note_id", "semantic_checksum")))
    rows = acts.where("action <> 'skipped'").join(found.select("path", "title", "body"), "path").withColumns({"origin": F.lit("manual"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    rows = stored(rows)
    _put(rows, root, "notes")
    _index(rows, root)
    _embed(rows.select(F.col("note_id").alias("id"), "title", F.col("body").alias("document")), root, "permanent_notes")
    return {r["action"]: r["count"] for r in acts.groupBy("action").count().collect()}


def run_all(spark: SparkSession, root: str, inbox: str, cfg: Config | None = None, skip_duplicates: bool = False, force: bool = False, model: Callable[[str], str] = memo.stub) -> dict:
    """Harvest, extract, review, connect and garden, one after the other; each starts from what the last has published."""
    return {
        "harvest": harvest(spark, root, inbox, cfg, skip_duplicates, force),
        "extract": extract(spark, root, model),
        "review": review_chunks(spark, root, cfg),
        "connect": connect(spark, root, cfg, model),
        "garden": garden(spark, root, cfg),
    }


def retry_failed(spark: SparkSession, root: str, source_id: str | None = None, assets: bool = False) -> dict:
    name = "assets" if assets else "chunks"
    store.publish(workflows.retry_failed(read(spark, root, name), source_id), root, name)
    return status(spark, root)


def set_paging(spark: SparkSession, root: str, source_id: str, start_file: int, start_book: int, drop_before: bool = False) -> dict:
    """A new content start of a source: its pages again, and pending chunks before it go."""
    every = read(spark, root, "chunks")
    own = workflows.set_paging(every.where(F.col("source_id") == source_id), start_file, start_book, drop_before)
    own = own.withColumn("locator", paging.locator(F.col("page_in_book"), F.col("section_path"), F.col("page_in_file")))
    store.publish(every.where(F.col("source_id") != source_id).unionByName(own), root, "chunks")
    return {"chunks": read(spark, root, "chunks").where(F.col("source_id") == source_id).count()}


def rechunk(spark: SparkSession, root: str, texts: DataFrame, cfg: Config | None = None) -> dict:
    """Chunks sources (source_id, text) again: chunks that are still there stay, stale ones go, only new ones are added."""
    c = (cfg or Config()).chunking
    old = read(spark, root, "chunks")
    fresh = chunk_rows(chunks(chapters(texts, "source_id", "text"), "source_id", c.size, c.overlap, c.min_section), "source_id", old.select("chunk_id", "source_id", "chunk_index"))
    kept, added, removed = persisted(old, fresh, "source_id")
    counts = {"added": added.count(), "removed": removed.count()}
    store.publish(kept.unionByName(align(added.withColumn("status", F.lit("pending")), SCHEMAS["chunks"])), root, "chunks")
    return counts


def status(spark: SparkSession, root: str) -> dict:
    return {r["entity"]: r["n"] for r in workflows.status({n: read(spark, root, n) for n in SCHEMAS}).collect()}


def doctor(spark: SparkSession, root: str) -> dict:
    """Checks of the store: tables that are there, one embedding space a collection, chapters without chunks, chunks without chapter."""
    spaces = index.identity(read(spark, root, "vectors")).groupBy("collection").count().where("count > 1").count()
    ch, ck = read(spark, root, "chapters"), read(spark, root, "chunks")
    return {
        "tables": all(store.published(spark, root, n) for n in SCHEMAS),
        "one_embedding_space": spaces == 0,
        "chapters_without_chunks": ch.join(ck, "chapter_id", "left_anti").count(),
        "chunks_without_chapter": ck.join(ch, "chapter_id", "left_anti").count(),
        "concepts_without_note": policies.without_notes(read(spark, root, "concepts"), read(spark, root, "notes")).count(),
    }


def topics(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Which existing topic map each name would go to."""
    return review.existing_map(spark.createDataFrame([(n,) for n in names], "topic string"), read(spark, root, "mocs"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="notegrove")
    p.add_argument("--root", required=True, help="folder of the tables; on a cluster one that all executors share")
    p.add_argument("--config", help="YAML file over the defaults")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--reset", action="store_true")
    h = sub.add_parser("harvest")
    h.add_argument("inbox")
    h.add_argument("--skip-duplicates", action="store_true")
    h.add_argument("--force", action="store_true")
    h.add_argument("--content-start-file", type=int)
    h.add_argument("--content-start-book", type=int)
    for name in ("extract", "review", "connect", "garden", "status", "doctor"):
        sub.add_parser(name)
    u = sub.add_parser("run-all")
    u.add_argument("inbox")
    u.add_argument("--skip-duplicates", action="store_true")
    u.add_argument("--force", action="store_true")
    q = sub.add_parser("ask")
    q.add_argument("question")
    q.add_argument("--no-graph", action="store_true")
    q.add_argument("--mode", choices=["hybrid", "vector"], default="hybrid")
    w = sub.add_parser("article")
    w.add_argument("topic")
    w.add_argument("--query", action="append", help="a further query; may be repeated")
    w.add_argument("--style", choices=["blog", "academic"], default="blog")
    w.add_argument("--personality", default="neutral")
    w.add_argument("--outline-only", action="store_true")
    w.add_argument("--mode", choices=["hybrid", "vector"], default="hybrid")
    x = sub.add_parser("reindex")
    x.add_argument("--collection", choices=list(INDEXED))
    x.add_argument("--force", action="store_true")
    b = sub.add_parser("rebuild")
    b.add_argument("vault")
    b.add_argument("--force", action="store_true")
    b.add_argument("--dry-run", action="store_true")
    sub.add_parser("sync-manual").add_argument("vault")
    r = sub.add_parser("retry-failed")
    r.add_argument("--source-id")
    r.add_argument("--assets", action="store_true")
    s = sub.add_parser("set-paging")
    s.add_argument("source_id")
    s.add_argument("--content-start-file", type=int, required=True)
    s.add_argument("--content-start-book", type=int, default=1)
    s.add_argument("--drop-before-start", action="store_true")
    a = p.parse_args(argv)
    spark, cfg = session(), load(a.config)
    out = {
        "init": lambda: init(spark, a.root, a.reset),
        "harvest": lambda: harvest(spark, a.root, a.inbox, cfg, a.skip_duplicates, a.force, a.content_start_file, a.content_start_book),
        "extract": lambda: extract(spark, a.root),
        "review": lambda: review_chunks(spark, a.root, cfg),
        "retry-failed": lambda: retry_failed(spark, a.root, a.source_id, a.assets),
        "set-paging": lambda: set_paging(spark, a.root, a.source_id, a.content_start_file, a.content_start_book, a.drop_before_start),
        "connect": lambda: connect(spark, a.root, cfg),
        "garden": lambda: garden(spark, a.root, cfg),
        "run-all": lambda: run_all(spark, a.root, a.inbox, cfg, a.skip_duplicates, a.force),
        "ask": lambda: ask(spark, a.root, a.question, cfg, not a.no_graph, mode=a.mode),
        "article": lambda: article(spark, a.root, a.topic, a.query, cfg, style=a.style, personality=a.personality, outline_only=a.outline_only, mode=a.mode),
        "reindex": lambda: reindex(spark, a.root, a.collection, a.force),
        "rebuild": lambda: rebuild(spark, a.root, a.vault, a.force, a.dry_run),
        "sync-manual": lambda: sync_manual(spark, a.root, a.vault),
        "status": lambda: status(spark, a.root),
        "doctor": lambda: doctor(spark, a.root),
    }[a.command]()
    print(json.dumps(out, ensure_ascii=False, indent=1, default=str))


if __name__ == "__main__":
    main()
