"""Inverted index and BM25 for batches of queries; terms have no diacritics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrove.functions.text import fold_diacritics, folded_tokens, query_tokens
from notegrove.session import stored

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc: str, text: Column, wanted: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf, dl): how often each term occurs, and the length of the text in terms; a row with a null term stands for
    the document itself. wanted (term): only these. Written once, it serves every batch of queries."""
    t = folded_tokens(F.coalesce(text, F.lit("")))
    # all terms take more room than the texts, so the texts are dealt by document, and grouping and joins by it send nothing more
    if wanted is None:
        n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a fixed number, as the texts' bytes say little of the terms' work
        docs, doc, t = docs.select(F.col(doc).alias("doc"), text.alias("__x")).repartition(n, "doc"), "doc", folded_tokens(F.coalesce("__x", F.lit("")))
    each = docs.select(F.col(doc).alias("doc"), t.alias("t")).select("doc", F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "t")).alias("term"))
    if wanted is not None:
        each = each.join(wanted.select("term", F.lit(True).alias("__w")), "term", "left").where(F.col("__w") | F.col("term").isNull())
    return each.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def refreshed(index: DataFrame, changed: DataFrame, doc: str, text: Column, gone: DataFrame | None = None) -> DataFrame:
    """An index after its documents changed: all postings of changed (and gone, a frame of ``doc``) ones are replaced."""
    out = index.join(changed.select(F.col(doc).alias("doc")).distinct(), "doc", "left_anti")
    if gone is not None:
        out = out.join(gone.select(F.col(doc).alias("doc")).distinct(), "doc", "left_anti")
    return out.unionByName(postings(changed, doc, text).select(out.columns))


def backfilled(index: DataFrame, docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """The index, or a whole new one where it is empty."""
    return index if index.limit(1).count() else postings(docs, doc, text).select(index.columns)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the terms of each query, at most 32 of them, without diacritics, once each."""
    t = F.array_distinct(F.transform(query_tokens(F.col("query_text")), fold_diacritics))
    return queries.select("query_id", F.explode(t).alias("term")).where("term <> ''")


def bm25_of(index: DataFrame, queries: DataFrame, k: int, exclude: str | None = None) -> DataFrame:
    """As ``bm25``, from stored postings."""
    terms = query_terms(queries)
    total = index.where("term is null").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    tf = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, "term").crossJoin(F.broadcast(total)).select("doc", "term", weight.alias("w")).join(terms, "term").groupBy("query_id", "doc").agg(F.sum("w").alias("score"))
    if exclude is not None:
        scored = scored.join(queries.select("query_id", exclude), "query_id").where(~F.col("doc").eqNullSafe(F.col(exclude))).drop(exclude)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc"))
    return scored.withColumn("bm25_rank", rank).where(F.col("bm25_rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, doc: str, text: Column, k: int, exclude: str | None = None) -> DataFrame:
    """(query_id, doc, score, bm25_rank), the best k of each query. queries: (query_id, query_text[, exclude]); an excluded
    document goes before the cut. Texts are read and split once: the postings of the queries' terms are stored."""
    return bm25_of(stored(postings(docs, doc, text, query_terms(queries).select("term").distinct())), queries, k, exclude)
