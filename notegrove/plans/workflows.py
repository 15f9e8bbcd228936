"""The programmatic entry points: harvest, review, connect, garden, ask, article, reindex, rebuild and status as frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrove.config import Config
from notegrove.functions import ids, paging
from notegrove.functions import text as tx
from notegrove.operators import chunking, cluster, fusion, memo, store
from notegrove.sources.files import compose

NO_EVIDENCE = "Sem evidência nas notas."
ASK_PROMPT = "Pergunta: {question}\n\nNotas:\n{context}\n\nResponda citando as notas."


def harvest(sources: DataFrame, known_chapters: DataFrame | None = None, cfg: Config | None = None, start_file: int = 1, start_book: int = 1) -> dict[str, DataFrame]:
    """Chapters and chunks of sources (source_id, text). Unchanged chapters are skipped; pages before the content start
    are dropped. Explicit page marks are read from the chunks and interpolated along each source."""
    cfg = cfg or Config()
    ch = chunking.chapters(sources, "source_id", "text").withColumn("chapter_id", ids.chapter_id(F.col("source_id"), F.col("chapter")))
    todo = ch.withColumn("chapter_checksum", F.sha2(tx.normalize(F.col("text")), 256))
    if known_chapters is not None:
        todo = chunking.changed_chapters(ch, known_chapters)
    c = cfg.chunking
    pieces = chunking.chunk_rows(chunking.chunks(todo, "source_id", c.size, c.overlap, c.min_section), "source_id")
    hinted = pieces.withColumn("page_hint", paging.page_hint(F.col("text"), F.lit(None)))
    paged = chunking.interpolated_pages(hinted, "source_id", "chunk_index", "page_hint").withColumnRenamed("page_inferred", "page_in_file")
    kept = paged.where(F.col("page_in_file").isNull() | (F.col("page_in_file") >= start_file))
    book = paging.book_page(F.col("page_in_file"), F.lit(start_file), F.lit(start_book))
    chunks = kept.withColumn("page_in_book", book).withColumn("locator", paging.locator(book, F.col("section_path"), F.col("page_in_file"))).withColumn("status", F.lit("pending"))
    return {"chapters": todo.select("chapter_id", "source_id", "title", "chapter_checksum"), "chunks": chunks.drop("page_hint", "piece")}


def set_paging(chunks: DataFrame, start_file: int, start_book: int, drop_before: bool = False) -> DataFrame:
    """Pages again after a new content start; pending chunks before it go, others only if told to."""
    early = F.coalesce(F.col("page_in_file") < start_file, F.lit(False))
    kept = chunks.where(~early | (F.lit(not drop_before) & (F.col("status") != "pending")))
    return kept.withColumn("page_in_book", paging.book_page(F.col("page_in_file"), F.lit(start_file), F.lit(start_book)))


def extract(chunks: DataFrame, cache: DataFrame, template: str, model: Callable[[str], str] = memo.stub) -> tuple[DataFrame, DataFrame]:
    """(answers, cache additions) of pending chunks through the memo."""
    calls = chunks.where("status = 'pending'").withColumn("prompt", memo.filled(template, {"text": F.col("text")}))
    calls = calls.withColumn("call_checksum", ids.call_checksum(F.sha2(F.lit(template), 256), F.sha2("prompt", 256), F.lit("model"), F.lit(0.0), F.lit("pt"), F.lit("")))
    return memo.memoised(calls, cache, model)


def review_chunks(chunks: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Approves confident chunks that await review."""
    t = (cfg or Config()).review.auto_approve
    return store.transition(chunks, ["awaiting_review"], "persisted", F.coalesce("review_confidence", F.lit(0.0)) >= t)


def garden(vectors: DataFrame, titles: DataFrame, known: DataFrame | None = None, cfg: Config | None = None, members: DataFrame | None = None) -> DataFrame:
    """(cluster, size, signature, terms) of clusters that have no topic map yet. members: (id, cluster) where they are known."""
    g = (cfg or Config()).garden
    if members is None:
        members = cluster.density_clusters(vectors, g.neighbours, g.threshold, g.min_cluster_size)
    found = cluster.signatures(members, "cluster", "id").where(F.col("size") >= g.min_notes)
    if known is not None:
        found = found.join(known.select(F.col("cluster_signature").alias("signature")), "signature", "left_anti")
    return found.join(cluster.terms(members.join(titles, "id"), "cluster", "title"), "cluster", "left")


def context(hits: DataFrame, most: int, chars: int) -> DataFrame:
    """(query_id, context): the best notes of each query as blocks, bodies cut; linked by ``note_id`` where hits have one."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    body = F.when(F.length("document") > chars, F.concat(F.substring("document", 1, chars), F.lit("..."))).otherwise(F.col("document"))
    block = F.concat(F.lit("### "), "title", F.lit("\n[[PERM-"), F.col("note_id" if "note_id" in hits.columns else "id").cast("string"), F.lit("]]\n\n"), body)
    top = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("query_id", F.struct("r", block.alias("b")).alias("s"))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), "\n\n").alias("context"))


def ask(questions: DataFrame, notes: DataFrame, vectors: DataFrame, cache: DataFrame, edges: DataFrame | None = None, cfg: Config | None = None, floor: fusion.Floor | None = None, model: Callable[[str], str] = memo.stub, names: DataFrame | None = None, lexical: str | None = None, mode: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """(answers, cache additions): (query_id, answer, cached) of a batch of questions; one without evidence gets a fixed answer
    and no call. names: (id, note_id), where notes are linked by another id than they are searched by. lexical: the folder of
    a stored index of the notes."""
    cfg = cfg or Config()
    hits = fusion.search(questions, notes, vectors, cfg.answer.topk_ask, mode, floor, edges, cfg.graph.hops, cfg.graph.decay, cfg.graph.most, lexical=lexical)
    if names is not None:
        hits = hits.join(names.select("id", "note_id"), "id")
    ctx = questions.select("query_id", "query_text").join(context(hits, cfg.answer.topk_ask, cfg.answer.ask_chars), "query_id", "left")
    calls = ctx.where("context is not null").withColumn("prompt", memo.filled(ASK_PROMPT, {"question": F.col("query_text"), "context": F.col("context")})).withColumn("call_checksum", F.sha2("prompt", 256))
    answers, additions = memo.memoised(calls.select("query_id", "prompt", "call_checksum"), cache, model)
    out = ctx.select("query_id").join(answers.select("query_id", F.col("response").alias("answer"), "cached"), "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(NO_EVIDENCE)))
    return out, additions


def sync_manual(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, note_id, action) of vault files against stored checksums: new, updated or skipped."""
    k = known.select("path", F.col("note_id"), F.col("semantic_checksum").alias("old"))
    x = files.join(k, "path", "left").withColumn("now", F.sha2(tx.embeddable(F.col("body")), 256))
    action = F.when(F.col("note_id").isNull(), "new").when(F.col("old") == F.col("now"), "skipped").otherwise("updated")
    return x.select("path", F.coalesce("note_id", ids.stable_id(F.col("path"))).alias("note_id"), action.alias("action"), F.col("now").alias("semantic_checksum"))


def rebuilt_notes(notes: DataFrame) -> DataFrame:
    """(path, content, origin) of stored notes, for ``plan_writes``."""
    meta = F.create_map(F.lit("id"), F.col("note_id"), F.lit("title"), F.coalesce("title", F.lit("")))
    return notes.select("path", F.when(F.col("body").isNotNull(), compose(meta, F.col("body"))).alias("content"), "origin")


def retry_failed(rows: DataFrame, source_id: str | None = None) -> DataFrame:
    """Failed chunks, or assets, of one source or of all wait again."""
    return store.transition(rows, ["failed"], "pending", None if source_id is None else F.col("source_id") == source_id)


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of all tables and of chunks by status; approved includes persisted."""
    out = store.entity_counts(tables)
    if "chunks" in tables:
        s = F.when(F.col("status") == "persisted", "approved").otherwise(F.col("status"))
        out = out.unionByName(tables["chunks"].groupBy(F.concat(F.lit("chunks:"), s).alias("entity")).agg(F.count("*").alias("n")))
    return out


