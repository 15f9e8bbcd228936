"""The phases between chunks and linked notes: extract, dedupe, approve or reject, and connect, each over whole tables.

Model calls go through ``memo.memoised``: a call is made once, its answer is stored, and what is new goes back to the cache.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrove.functions import ids
from notegrove.functions import text as tx
from notegrove.operators import memo, notes, review
from notegrove.operators.vectors import knn
from notegrove.session import stored

CANDIDATE = "status string, relevance int, thesis string, definition string, anchor_quote string"
ANSWER = f"chunk_status string, summary string, key_concepts array<string>, candidates array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>>"
REPAIR = "O JSON abaixo é inválido. Responda somente com o JSON corrigido.\n\n{response}"
DECISIONS = ("create_new", "ignore", "refine_existing", "merge")


def parsed(response: Column, schema: str, required: str) -> Column:
    """The JSON of an answer in a schema; null where there is none or the required field is missing."""
    got = F.from_json(tx.json_payload(response), schema, {"mode": "PERMISSIVE"})
    return F.when(got[required].isNotNull(), got)


def answered(calls: DataFrame, cache: DataFrame, model: Callable[[str], str], schema: str, required: str) -> tuple[DataFrame, DataFrame]:
    """(calls with ``answer``, cache additions): an answer that cannot be read is asked for once more with a prompt to repair it;
    what still cannot be read is null."""
    first, new = memo.memoised(calls, cache, model)
    first = stored(first.withColumn("answer", parsed(F.col("response"), schema, required)))
    bad = first.where("answer is null").select(F.col("call_checksum").alias("of"), memo.filled(REPAIR, {"response": F.col("response")}).alias("prompt")).distinct()
    again, repaired = memo.memoised(bad.withColumn("call_checksum", F.sha2("prompt", 256)), cache, model)
    fixed = again.select(F.col("of").alias("call_checksum"), parsed(F.col("response"), schema, required).alias("__fixed")).dropDuplicates(["call_checksum"])
    out = first.join(fixed, "call_checksum", "left").withColumn("answer", F.coalesce("answer", "__fixed")).drop("__fixed")
    return out, new.unionByName(repaired).dropDuplicates(["call_checksum"])


def extract(chunks: DataFrame, cache: DataFrame, template: str, model: Callable[[str], str] = memo.stub, quote_required: bool = True) -> dict[str, DataFrame]:
    """Pending chunks (chunk_id, source_id, text, status) through the model: ``chunks`` with their status (awaiting_review or
    failed), summary, review confidence and draft; ``concepts``, one for each candidate that passes the filter; ``cache``, the new
    answers."""
    calls = chunks.where("status = 'pending'").withColumn("prompt", memo.filled(template, {"text": F.col("text"), "source_id": F.col("source_id")}))
    calls = calls.withColumn("call_checksum", ids.call_checksum(F.sha2(F.lit(template), 256), F.sha2("prompt", 256), F.lit("model"), F.lit(0.0), F.lit("pt"), F.lit("")))
    got, new = answered(calls.select("chunk_id", "source_id", "call_checksum", "prompt"), cache, model, ANSWER, "chunk_status")
    got = stored(got.select("chunk_id", "source_id", "answer"))
    each = got.where("answer is not null").select("chunk_id", "source_id", F.col("answer.chunk_status").alias("chunk_status"), F.explode("answer.candidates").alias("c")).select("chunk_id", "source_id", "chunk_status", "c.*")
    each = each.withColumn("reason", review.reject_reason(F.coalesce("status", F.lit("")), F.col("relevance"), F.col("thesis"), F.col("definition"), F.col("anchor_quote"), quote_required))
    quoted = F.trim(F.coalesce("anchor_quote", F.lit(""))) != ""
    n = each.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("ok"), F.avg("relevance").alias("relevance"), F.avg(quoted.cast("double")).alias("quoted"))
    whole = got.join(n, "chunk_id", "left")
    conf = review.review_confidence(F.col("answer.chunk_status"), F.col("answer.summary"), F.size(F.coalesce("answer.key_concepts", F.array().cast("array<string>"))), F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0)), F.coalesce("relevance", F.lit(0.0)), F.coalesce("quoted", F.lit(0.0)))
    draft = notes.literature_note(F.col("answer.summary"), F.coalesce("answer.key_concepts", F.array().cast("array<string>")), F.array().cast("array<string>"), F.lit(None).cast("string"))
    failed = F.col("answer").isNull()
    out = whole.select("chunk_id", F.when(failed, "failed").otherwise("awaiting_review").alias("status"), F.col("answer.summary").alias("summary"), F.when(~failed, conf).alias("review_confidence"), F.when(~failed, draft).alias("draft"))
    ok = each.where("reason is null")
    thesis = F.sha2(tx.normalize(F.col("thesis")), 256)
    concepts = ok.select(ids.concept_id(F.col("source_id"), F.col("chunk_id"), thesis).alias("concept_id"), "source_id", "chunk_id", "thesis", "definition", "relevance", "anchor_quote", thesis.alias("thesis_hash"), F.to_json(F.struct("thesis", "definition", "relevance", "anchor_quote")).alias("candidate_json"), F.lit("awaiting_review").alias("status")).dropDuplicates(["concept_id"])
    return {"chunks": out, "concepts": concepts, "cache": new}


def deduplicated(candidates: DataFrame, vectors: DataFrame, threshold: float, decide: DataFrame, k: int = 5) -> DataFrame:
    """Candidates (concept_id, vector) against existing notes: (concept_id, nearest, distance, decision, status, refines). Where
    the nearest note is within the threshold, the decision of ``decide`` (concept_id, decision, target_note_id) counts, and one that
    is missing or unknown approves; all others are created."""
    near = knn(vectors, candidates.select(F.col("concept_id").alias("query_id"), "vector"), k).where("vector_rank = 1").select(F.col("query_id").alias("concept_id"), F.col("id").alias("nearest"), "distance")
    out = candidates.select("concept_id").join(near, "concept_id", "left").join(decide.select("concept_id", F.col("decision").alias("__d"), "target_note_id"), "concept_id", "left")
    close = F.coalesce(F.col("distance") <= 2 * (1 - threshold), F.lit(False))
    decision = F.when(close & F.col("__d").isin(*DECISIONS), F.col("__d")).otherwise("create_new")
    refines = F.when(decision.isin("refine_existing", "merge"), F.col("target_note_id"))
    return out.select("concept_id", "nearest", "distance", decision.alias("decision"), F.when(decision == "ignore", "duplicate").otherwise("approved").alias("status"), refines.alias("refines"))


def decided(chunks: DataFrame, concepts: DataFrame, approve: DataFrame, reject: DataFrame) -> dict[str, DataFrame]:
    """Chunks that await review are approved or rejected (frames of chunk_id; both means rejected), with their concepts: those of
    an approved chunk become ``extracted``, those of a rejected one ``rejected``. ``literature``: (id, document) to embed."""
    mark = approve.select("chunk_id", F.lit("persisted").alias("__to")).unionByName(reject.select("chunk_id", F.lit("rejected").alias("__to"))).groupBy("chunk_id").agg(F.max("__to").alias("__to"))
    to = chunks.where("status = 'awaiting_review'").select("chunk_id").join(mark, "chunk_id")
    after = chunks.join(to, "chunk_id", "left").withColumn("status", F.coalesce("__to", "status")).drop("__to")
    own = concepts.join(to, "chunk_id", "left").withColumn("status", F.when(F.col("__to") == "persisted", "extracted").otherwise(F.coalesce("__to", "status"))).drop("__to")
    text = chunks.join(to.where("__to = 'persisted'"), "chunk_id").select(F.col("chunk_id").alias("id"), F.concat("chunk_id", F.lit("\n\n"), F.substring(F.coalesce("draft", F.lit("")), 1, 3000)).alias("document"))
    return {"chunks": after, "concepts": own, "literature": text}


def connect(concepts: DataFrame, connections: DataFrame, titles: DataFrame, stored_notes: DataFrame, prefix: str = "PERM") -> dict[str, DataFrame]:
    """Approved concepts (concept_id, note_id or null, thesis, definition, locator, literature_ref, refines) with the connections
    that the model proposed (concept_id, target, relation_type, description) become notes: ``notes`` (note_id, concept_id, body,
    semantic_checksum, embed), ``edges`` between known notes and ``backlinks`` of their targets. A concept keeps its note's id; a note
    whose semantic checksum is unchanged is not embedded again. titles: (id, title); stored_notes: (note_id, semantic_checksum)."""
    own = concepts.withColumn("note_id", F.coalesce("note_id", ids.stable_id(F.col("concept_id"))))
    links = connections.join(own.select("concept_id", F.col("note_id").alias("source")), "concept_id").select("source", "target", "relation_type", "description")
    links = links.where(F.col("source") != F.col("target"))
    every = notes.resolved(notes.with_refinements(links, own.select(F.col("note_id").alias("source"), F.col("refines").alias("target"))), titles, prefix)
    every = stored(every.groupBy("source", "target", "relation_type").agg(F.min("description").alias("description"), F.first("wiki_link").alias("wiki_link")))
    none = F.lit(None).cast("string")
    images = F.array().cast("array<struct<path:string,description:string>>")
    body = notes.permanent_note(F.col("thesis"), F.col("definition"), none, none, none, F.col("literature_ref"), F.col("locator"), images, F.col("connections"))
    made = own.join(notes.gathered(every).withColumnRenamed("source", "note_id"), "note_id", "left").select("note_id", "concept_id", body.alias("body"))
    made = made.withColumn("semantic_checksum", F.sha2(tx.embeddable(F.col("body")), 256))
    old = stored_notes.select("note_id", F.col("semantic_checksum").alias("__old"))
    made = made.join(old, "note_id", "left").withColumn("embed", ~F.col("semantic_checksum").eqNullSafe(F.col("__old"))).drop("__old")
    edges = every.join(titles.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "relation_type")
    back = edges.select(F.col("target").alias("note_id"), F.struct("source", F.concat(F.lit("- "), notes.wiki_link(F.col("source"), none, prefix), F.lit(" ("), tx.inverse_relation(F.col("relation_type")), F.lit(")")).alias("line")).alias("s"))
    backlinks = back.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("s")), lambda s: s["line"]), "\n").alias("body"))
    return {"notes": made, "edges": edges, "backlinks": backlinks}
