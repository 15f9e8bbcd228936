"""Tables of the note store: schemas, keys and merge policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "t": T.TimestampType(), "a": T.ArrayType(T.StringType())}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in spec.split())])


SCHEMAS = {
    "files": _schema("path:s file_checksum:s origin_type:s source_id:s last_seen_at:t"),
    "sources": _schema("source_id:s citekey:s title:s authors:a year:i file_checksum:s extraction_checksum:s origin_path:s origin_type:s document_type:s bibliography_json:s abnt_reference:s processing_status:s total_pages_file:i content_start_file:i content_start_book:i cost_usd:d tokens_in:l tokens_out:l created_at:t updated_at:t"),
    "chapters": _schema("chapter_id:s source_id:s title:s chapter_checksum:s locator:s"),
    "chunks": _schema("chunk_id:s source_id:s chapter_id:s text:s checksum:s locator:s section_path:s status:s chunk_index:i page_in_file:i page_in_book:i page_confidence:s literature_id:s literature_path:s review_confidence:d summary_json:s"),
    "concepts": _schema("concept_id:s source_id:s chunk_id:s anchor_hash:s thesis_hash:s note_id:s candidate_json:s status:s"),
    "notes": _schema("note_id:s source_id:s path:s title:s body:s frontmatter_json:s origin:s semantic_checksum:s auto_checksum:s embedding_model:s embedding_input_hash:s created_at:t updated_at:t"),
    "mocs": _schema("moc_id:s topic:s path:s body:s frontmatter_json:s origin:s cluster_signature:s created_at:t updated_at:t"),
    "assets": _schema("asset_id:s source_id:s chapter_id:s path:s image_checksum:s page_in_file:i context_snippet:s status:s description:s"),
    "llm_cache": _schema("call_checksum:s request_json:s response_json:s created_at:t"),
    "note_connections": _schema("source_note_id:s target_note_id:s relation_type:s description:s created_at:t"),
    "runs": _schema("run_id:l pipeline_signature:s status:s started_at:t finished_at:t cost_usd:d tokens_in:l tokens_out:l duplicates_file:l duplicates_content:l duplicates_semantic:l"),
}
KEYS = {"files": ["path"], "sources": ["source_id"], "chapters": ["chapter_id"], "chunks": ["chunk_id"], "concepts": ["concept_id"], "notes": ["note_id"], "mocs": ["moc_id"], "assets": ["asset_id"], "llm_cache": ["call_checksum"], "note_connections": ["source_note_id", "target_note_id", "relation_type"], "runs": ["run_id"]}
#: O overwrites, C keeps the existing value where the incoming is null, K keeps it always, + adds.
POLICIES = {
    "files": {"source_id": "C"},
    "sources": {"citekey": "K", "origin_path": "K", "origin_type": "K", "created_at": "K", "document_type": "C", "bibliography_json": "C", "abnt_reference": "C", "total_pages_file": "C", "content_start_file": "C", "content_start_book": "C", "cost_usd": "+", "tokens_in": "+", "tokens_out": "+"},
    "chapters": {"source_id": "K"},
    "chunks": {"source_id": "K", "chapter_id": "K", "chunk_index": "C", "page_in_file": "C", "page_in_book": "C", "literature_id": "C", "literature_path": "C", "review_confidence": "C", "summary_json": "C"},
    "concepts": {"note_id": "C", "candidate_json": "C", "status": "C", "source_id": "K", "chunk_id": "K"},
    "notes": {"path": "C", "body": "C", "frontmatter_json": "C", "auto_checksum": "C", "embedding_model": "C", "source_id": "K", "created_at": "K", "embedding_input_hash": "K"},
    "mocs": {"path": "C", "body": "C", "frontmatter_json": "C", "created_at": "K"},
    "assets": {"chapter_id": "C", "page_in_file": "C", "status": "K", "description": "K", "image_checksum": "K", "source_id": "K"},
    "llm_cache": {},
    "note_connections": {},
    "runs": {"duplicates_file": "+", "duplicates_content": "+", "duplicates_semantic": "+", "started_at": "K", "pipeline_signature": "K"},
}
CHUNK_STATES = ("pending", "awaiting_review", "approved", "persisted", "rejected", "failed", "extracted", "skipped")


def align(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The frame in the declared columns and types; missing ones get their default. Additive and idempotent."""
    have, defaults = set(df.columns), defaults or {}
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])
