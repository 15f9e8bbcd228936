"""The vector store: five collections of documents with metadata and a vector, as one table.

Rows are (collection, id, document, metadata, embedding, provider, model). Each operator gives the next snapshot, which
``store.publish`` writes; partitioned by collection, a write touches one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrove.functions.text import folded_tokens
from notegrove.operators.vectors import EmbeddingSpaceMismatch

#: The collections.
COLLECTIONS = ("sources", "chunks", "permanent_notes", "mocs", "literature_notes")
COLUMNS = ("collection", "id", "document", "metadata", "embedding", "provider", "model")
SCHEMA = "collection string, id string, document string, metadata map<string,string>, embedding array<float>, provider string, model string"


def known(collection: str) -> str:
    if collection not in COLLECTIONS:
        raise ValueError(f"unknown collection {collection!r}")
    return collection


def metadata(fields: dict[str, Column]) -> Column:
    """A map of strings: lists are joined by a comma, and what is null is left out."""
    text = {k: F.array_join(v.cast("array<string>"), ", ") if kind == "list" else v.cast("string") for k, (v, kind) in ((k, v if isinstance(v, tuple) else (v, "")) for k, v in fields.items())}
    return F.map_filter(F.create_map(*[x for k, v in text.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def hashed_vectors(rows: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, embedding): an offline embedding, for use without a model: counts of the terms' hashes, of length 1; zeros for a text
    without terms. Columnar functions only; terms are counted before they are gathered."""
    terms = rows.select(F.col(key), F.explode(folded_tokens(F.coalesce(text, F.lit("")))).alias("t"))
    slot = F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % size
    n = terms.select(key, slot.cast("int").alias("s")).groupBy(key, "s").agg(F.count("*").alias("n"))
    whole = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))  # at most ``size`` entries
    value = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i] / F.col("norm"), F.lit(0.0)))
    return rows.select(key).join(whole, key, "left").select(key, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), size)).otherwise(value).alias("embedding"))


def upsert(index: DataFrame, incoming: DataFrame, collection: str) -> DataFrame:
    """Replaces documents of a collection by id; incoming: (id, document, metadata, embedding, provider, model), of rows with
    one id the largest document stays. Vectors of another provider or model than the collection's are an error."""
    new = incoming.groupBy("id").agg(F.max_by(F.struct(*COLUMNS[2:]), F.coalesce("document", F.lit(""))).alias("x")).select(F.lit(known(collection)).alias("collection"), "id", "x.*")
    guard(index.where(F.col("collection") == collection), new)
    return index.join(new.select("collection", "id"), ["collection", "id"], "left_anti").select(*COLUMNS).unionByName(new)


def identity(index: DataFrame) -> DataFrame:
    """(collection, provider, model): the embedding spaces that are stored."""
    return index.select("collection", "provider", "model").distinct()


def guard(held: DataFrame, new: DataFrame) -> None:
    """Raises if two frames of vectors do not have one space."""
    spaces = held.select("provider", "model").unionByName(new.select("provider", "model")).distinct().limit(3).collect()
    if len(spaces) > 1:
        raise EmbeddingSpaceMismatch(" and ".join(sorted(f"{s['provider']}/{s['model']}" for s in spaces)))


def removed(index: DataFrame, ids: DataFrame, collection: str) -> DataFrame:
    """Without the ids (a frame of ``id``) of a collection."""
    return index.join(ids.select(F.lit(known(collection)).alias("collection"), "id").distinct(), ["collection", "id"], "left_anti").select(*COLUMNS)


def reset(index: DataFrame, collection: str) -> DataFrame:
    return index.where(F.col("collection") != known(collection))


def export(index: DataFrame, collection: str) -> DataFrame:
    return index.where(F.col("collection") == known(collection)).drop("collection")


def to_embed(rows: DataFrame, index: DataFrame, collection: str, key: str, force: bool = False) -> DataFrame:
    """Rows to embed again. Sources and chunks that are there stay unless forced; the other collections always go, but for rows
    without a text."""
    if force or known(collection) not in ("sources", "chunks"):
        return rows.where(F.coalesce(F.trim("document"), F.lit("")) != "")
    return rows.join(export(index, collection).select(F.col("id").alias(key)), key, "left_anti")


def literature_text(status: Column, file_text: Column, summary: Column, concepts: Column, chunk: Column) -> Column:
    """What is embedded for a literature note: 3,000 characters of its file, else its summary and concepts, else 1,500 characters
    of its chunk; nothing unless it is approved or persisted."""
    text = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    body = F.coalesce(F.substring(text(file_text), 1, 3000), F.when(text(summary).isNotNull(), F.concat_ws("\n", summary, F.array_join(F.coalesce(concepts, F.array().cast("array<string>")), ", "))), F.substring(text(chunk), 1, 1500))
    return F.when(status.isin("approved", "persisted"), body)
