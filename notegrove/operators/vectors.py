"""Exact nearest neighbours for batches of query vectors, and the embedding-space guard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that one scan of the vectors answers, bytes of a task's best of them, and the queries and rows that are
#: compared at a time; the rows are also those of a batch between the JVM and Python.
SCAN_BYTES, BEST_BYTES, QUERY_ROWS, ROWS = 8 << 20, 16 << 20, 256, 1024


class _Best:
    """The k nearest of each query among the vectors that a task has seen, by rounded distance, then id."""

    def __init__(self, queries: int, k: int):
        self.d, self.id = np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, first: int, d: np.ndarray, ids: np.ndarray) -> None:
        """Vectors with these ids, by their distances from the queries from ``first`` on."""
        k = self.d.shape[1]
        some = np.flatnonzero(np.fmin.reduce(d, 1) <= self.d[first : first + len(d), k - 1] + 2e-9)  # the others have k nearer ones; a NaN says nothing of its neighbours
        own = first + some
        d = np.hstack([self.d[own], d[some]])
        ids = np.hstack([self.id[own], np.broadcast_to(ids, (len(d), len(ids)))])
        r = np.round(d, 9)
        last = np.partition(r, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(r <= last[:, None])  # all ties of the last one, cut by id below
        order = np.lexsort((ids[row, col], r[row, col], row))
        row, col = row[order], col[order]
        start = np.searchsorted(row, np.arange(len(d)))
        take = (start[:, None] + np.arange(k)).ravel()
        self.d[own], self.id[own] = d[row[take], col[take]].reshape(-1, k), ids[row[take], col[take]].reshape(-1, k)


def _blocks(queries: DataFrame, k: int) -> Iterator[tuple[list, list, np.ndarray]]:
    """(ids, ids to leave out, vectors) of as many queries as one scan answers, read one partition after another."""
    rows, size = [], 0
    for r in queries.toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        size += 8 * len(r["v"])
        if size >= SCAN_BYTES or 16 * k * len(rows) >= BEST_BYTES:
            yield _packed(rows)
            rows, size = [], 0
    if rows:
        yield _packed(rows)


def _packed(rows: list) -> tuple[list, list, np.ndarray]:
    return [r["query_id"] for r in rows], [r["exclude"] for r in rows], np.array([r["v"] for r in rows], np.float64)


def knn(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, id, distance, similarity, vector_rank), the k nearest by squared distance, ties by id. queries: (query_id,
    vector[, exclude]); a vector whose id is ``exclude``, or with exclude_self the query's own id, is left out. Query vectors go
    to the executors in blocks of SCAN_BYTES, each answered by one scan, in which a task keeps the k best of every query."""
    spark = vectors.sparkSession
    out = F.col("query_id") if exclude_self else F.col("exclude") if "exclude" in queries.columns else F.lit(None)
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", out.cast("long").alias("exclude"), F.col("vector").alias("v"))
    schema = "query_id long, id long, distance double"
    every = spark.createDataFrame([], schema)
    source = vectors.select(F.col(vec).cast("long"), embedding).where(F.col(embedding).isNotNull() & F.col(vec).isNotNull())
    for block in _blocks(asked, k):
        held = spark.sparkContext.broadcast(block)

        def near(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, without, q = held.value
            best, norm = _Best(len(ids), k), (q * q).sum(1)
            without = [(x, i) for i, x in enumerate(without) if x is not None]
            left_out, asker = np.array(sorted(without), np.int64).reshape(-1, 2).T
            # whatever the size of a batch: what is held beside it does not grow with the rows
            for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
                own = b.column(0).to_numpy()
                x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                low, high = np.searchsorted(left_out, own), np.searchsorted(left_out, own, "right")
                met = np.repeat(np.arange(len(own)), high - low)  # rows that some queries leave out, once for each
                by = asker[np.arange(len(met)) - np.repeat(np.cumsum(high - low) - high, high - low)]
                for i in range(0, len(ids), QUERY_ROWS):
                    s = slice(i, i + QUERY_ROWS)
                    d = np.maximum(norm[s, None] + (x * x).sum(1)[None, :] - 2 * (q[s] @ x.T), 0.0)
                    here = (by >= i) & (by < i + QUERY_ROWS)
                    d[by[here] - i, met[here]] = np.inf
                    best.add(i, d, own)
            for i in range(0, len(ids), QUERY_ROWS):
                d, found = best.d[i : i + QUERY_ROWS], best.id[i : i + QUERY_ROWS]
                row, col = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i + r] for r in row.tolist()], pa.int64()), pa.array(found[row, col]), pa.array(d[row, col])], names=["query_id", "id", "distance"])

        every = every.unionByName(source.mapInArrow(near, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    return every.withColumn("vector_rank", rank).where(F.col("vector_rank") <= k).withColumn("similarity", 1 - F.col("distance") / 2)


class EmbeddingSpaceMismatch(ValueError):
    """Stored vectors come from another provider or model."""


def guard_space(stored: tuple[str, str] | None, provider: str, model: str, reset: bool = False) -> bool:
    """Whether vectors may be added as they are; an empty store matches. reset: say no instead of raising."""
    if stored is None or stored == (provider, model):
        return True
    if reset:
        return False
    raise EmbeddingSpaceMismatch(f"stored {stored[0]}/{stored[1]}, configured {provider}/{model}")


def sanitized(metadata: dict) -> dict[str, str]:
    """Metadata as strings: lists joined, nulls left out."""
    return {k: ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for k, v in metadata.items() if v is not None}
