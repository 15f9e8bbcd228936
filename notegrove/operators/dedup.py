"""Duplicate layers of an ingest, semantic duplicates and even samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrove.operators.vectors import knn
from notegrove.session import stored


def earliest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the earliest other that has the same key (null for the earliest itself). By aggregation and
    join, so a key of very many rows is no single window."""
    first = df.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    return df.join(first, key).withColumn("duplicate_of", F.when(F.col(order) != F.col("first"), F.col("first"))).drop("first")


def cascade(files: DataFrame, order: str, byte_key: str, text_key: str, similarity: DataFrame | None = None, threshold: float = 0.88) -> DataFrame:
    """Adds dup_kind (``file``, ``content``, ``semantic`` or ``new``) and duplicate_of: an earlier file of the same
    bytes, else of the same text, else a source similar enough. similarity: (order, best, best_of). The keys, mostly hashes of
    whole texts, are computed once."""
    files = stored(files)
    b = files.groupBy(byte_key).agg(F.min(order).alias("__b"))
    t = files.groupBy(text_key).agg(F.min(order).alias("__t"))
    out = files.join(b, byte_key).join(t, text_key)
    if similarity is None:
        out = out.withColumn("best", F.lit(None).cast("double")).withColumn("best_of", F.lit(None).cast(files.schema[order].dataType))
    else:
        out = out.join(similarity, order, "left")
    kind = F.when(F.col("__b") < F.col(order), "file").when(F.col("__t") < F.col(order), "content").when(F.col("best") >= threshold, "semantic").otherwise("new")
    return out.withColumn("dup_kind", kind).withColumn("duplicate_of", F.when(kind == "file", F.col("__b")).when(kind == "content", F.col("__t")).when(kind == "semantic", F.col("best_of"))).drop("__b", "__t", "best", "best_of")


def semantic(vectors: DataFrame, samples: DataFrame, of: DataFrame, neighbours: int = 3, threshold: float = 0.88) -> DataFrame:
    """(source, similarity): sources whose nearest vectors to the samples (query_id, vector) are similar enough, with
    the best similarity. of: (id, source)."""
    near = knn(vectors, samples, neighbours, exclude_self=True).where(F.col("similarity") >= threshold)
    return near.join(of, "id").groupBy("source").agg(F.max("similarity").alias("similarity"))


def even_sample(df: DataFrame, group: str, order: str, k: int = 5) -> DataFrame:
    """All rows of a group of at most k, else those at floor(i n / k). A group is one document's pieces."""
    w = Window.partitionBy(group)
    out = df.withColumn("__n", F.count("*").over(w)).withColumn("__p", F.row_number().over(w.orderBy(order)) - 1)
    # p = floor(i n / k) for some i < k, that is i = ceil(p k / n)
    i = F.ceil(F.col("__p") * k / F.col("__n"))
    return out.where((F.col("__n") <= k) | ((i < k) & (F.floor(i * F.col("__n") / k) == F.col("__p")))).drop("__n", "__p")
