"""An inverted-file index of vectors: approximate nearest neighbours with a measured recall, and exact ones by the same cells.

Coarse centroids are fitted on a bounded sample (``SAMPLE_BYTES``; the rows whose ids hash lowest, so every row may be in it); every
row is stored in the list of its nearest centroid, a folder a cell, with the cell's radius. A search reads the folders of the cells
that its queries probe and no others. How many cells a query probes is measured when the index is built: the fewest
by which the true neighbours of sampled rows, found by a scan, are in the probed cells as often as ``target`` says.

``exact`` takes the distance of the k-th neighbour found in the nearest cells as a bound and then reads every cell that its radius lets
come within the bound, so it loses none; what it reads falls with the spread of the data.

Vectors and queries travel as packed blocks of at most ``BLOCK_BYTES``, many to a cell, so a cell with a large share
of all rows is many rows of a join, which adaptive execution may split. What reaches the driver: the sample, the centroids (at most ``MOST_CELLS``) and the
numbers of probed cells. Rows without id or vector, and those with another number of components than most of the sample, are
left out; the index is empty where there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegrove.operators.vectors import knn
from notegrove.session import stored

SAMPLE_BYTES, MOST_CELLS, BLOCK_BYTES = 32 << 20, 1 << 14, 64 << 10
#: Sampled rows by which the probes are measured, and queries whose best are held in a task.
MEASURED, HELD = 256, 1 << 15
NONE = -(2**63)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Batches between the JVM and Python of so many rows, for jobs that end inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class Index:
    """A stored index as a search needs it: centroids with radius and size (a row a cell), and the cells that a query probes."""

    root: str
    centers: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    probes: int

    @property
    def cells(self) -> int:
        return len(self.centers)


def kind_of(df: DataFrame, column: str) -> str:
    """The type in which a frame's vectors travel: floats stay floats."""
    return "array<float>" if df.schema[column].dataType.simpleString() == "array<float>" else "array<double>"


def _usable(vectors: DataFrame, vec: str, embedding: str, dimensions: int | None = None) -> DataFrame:
    rows = vectors.where(F.col(vec).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x)))
    rows = rows if dimensions is None else rows.where(F.size(embedding) == dimensions)
    return rows.select(F.col(vec).cast("long").alias("id"), F.col(embedding).cast(kind_of(vectors, embedding)).alias("v"))


def _sample(vectors: DataFrame, vec: str, embedding: str, seed: int) -> np.ndarray:
    rows = _usable(vectors, vec, embedding)
    first = rows.agg(F.mode(F.size("v"), True)).first()[0]
    if not first:
        return np.zeros((0, 0))
    most = max(1, SAMPLE_BYTES // (8 * first))
    got = rows.where(F.size("v") == first).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).select("v").toPandas()["v"]
    return np.array(got.tolist(), np.float64)


def fitted(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centroids of a sample by rounds of nearest means; a cell that is left empty keeps its centroid."""
    rnd = np.random.RandomState(seed)
    centers = sample[np.sort(rnd.permutation(len(sample))[:cells])].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(sample[i : i + 4096], centers).argmin(1) for i in range(0, len(sample), 4096)])
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, sample)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0.0)


def between(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of each row of y from its own rows of x (rows x n x components): the same bits whichever is which."""
    off = np.ascontiguousarray(y[:, None, :] - x)
    return (off * off).sum(2)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def assigned(vectors: DataFrame, centers: np.ndarray, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v, cell, far): every usable row with its nearest centroid and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                d = _distances(matrix(part.column(1), len(part)), centers)
                yield part.append_column("cell", pa.array(d.argmin(1).astype(np.int32))).append_column("far", pa.array(np.sqrt(d.min(1))))

    return _usable(vectors, vec, embedding, centers.shape[1]).mapInArrow(run, f"id long, v {kind_of(vectors, embedding)}, cell int, far double")


def packed(rows: DataFrame, kinds: dict[str, str], dimensions: int, width: int = 8, block: int = BLOCK_BYTES, tasks: int | None = None) -> DataFrame:
    """Rows (cell, v, ...) as blocks: (cell, v binary, each column of kinds (name to dtype) binary), a cell in as many blocks as its
    rows take. width: bytes of a stored component; block: bytes of a block at most; tasks: the session's shuffle partitions by default."""
    most, names = max(1, block // (width * dimensions)), list(kinds)
    n = tasks or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            cell = b.column("cell").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for k in range(i, j, most):
                    part = b.slice(k, min(most, j - k))
                    v = matrix(part.column("v"), len(part)).astype(f"f{width}").tobytes()
                    cols = [part.column(c).to_numpy(zero_copy_only=False).astype(kinds[c]).tobytes() for c in names]
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[i])], pa.int32()), pa.array([v]), *(pa.array([c]) for c in cols)], names=["cell", "v", *names])

    dealt = rows.select("cell", "v", *names).repartitionByRange(n, "cell", F.xxhash64(names[0])).sortWithinPartitions("cell", names[0])
    return dealt.mapInArrow(run, "cell int, v binary, " + ", ".join(f"{c} binary" for c in names))


def build(vectors: DataFrame, root: str, cells: int | None = None, target: float = 0.95, k: int = 10, seed: int = 1, vec: str = "vec_id", embedding: str = "embedding") -> Index:
    """Writes an index of all usable rows below ``root``, which must not exist. cells: about the square root of the rows by default."""
    spark = vectors.sparkSession
    sample = _sample(vectors, vec, embedding, seed)
    if cells is None:
        cells = round(vectors.count() ** 0.5)
    centers = fitted(sample, max(1, min(cells, MOST_CELLS, len(sample))), seed=seed) if len(sample) else np.zeros((0, 1))
    width = 4 if kind_of(vectors, embedding) == "array<float>" else 8
    with batches_of(spark, 2000):
        rows = stored(assigned(vectors, centers, vec, embedding)) if len(centers) else None
        if rows is None:
            rows = spark.createDataFrame([], "id long, v array<double>, cell int, far double")
        packed(rows, {"id": "i8"}, centers.shape[1], width).write.partitionBy("cell").parquet(f"{root}/lists")
    of = {r["cell"]: r for r in rows.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # a row a cell
    table = [(c, x.tolist(), of[c]["far"] if c in of else -1.0, of[c]["n"] if c in of else 0) for c, x in enumerate(centers)]
    spark.createDataFrame(table, "cell int, center array<double>, radius double, n long").coalesce(1).write.parquet(f"{root}/centers")
    spark.createDataFrame([(_measured(rows, centers, target, k, seed), width)], "probes int, width int").coalesce(1).write.parquet(f"{root}/meta")
    return opened(spark, root)


def _measured(rows: DataFrame, centers: np.ndarray, target: float, k: int, seed: int) -> int:
    """The fewest cells that hold the share ``target`` of the k true neighbours of MEASURED sampled rows."""
    if not len(centers):
        return 1
    asked = rows.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(MEASURED).select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    asked = stored(asked)
    near = knn(rows, asked, k, exclude_self=True, vec="id", embedding="v").select("query_id", "id")
    found = near.join(rows.select("id", "cell"), "id").groupBy("query_id").agg(F.collect_list("cell").alias("cells")).collect()  # k a query
    order = {r["query_id"]: np.argsort(_distances(np.array([r["vector"]]), centers)[0], kind="stable") for r in asked.collect()}
    ranks = sorted(int(np.flatnonzero(order[r["query_id"]] == c)[0]) + 1 for r in found for c in r["cells"])
    return ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] if ranks else 1


def opened(spark: SparkSession, root: str) -> Index:
    # appends write the cells again; radius and size only grow
    rows = spark.read.parquet(f"{root}/centers").groupBy("cell").agg(F.first("center").alias("center"), F.max("radius").alias("radius"), F.max("n").alias("n")).collect()
    rows = sorted(rows, key=lambda r: r["cell"])
    meta = spark.read.parquet(f"{root}/meta").first()
    return Index(root, np.array([r["center"] for r in rows], np.float64).reshape(len(rows), -1 if rows else 1), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows]), meta["probes"])


def append(index: Index, vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding") -> Index:
    """Adds rows to their lists; radius and sizes follow, centroids and probes stay."""
    spark = vectors.sparkSession
    width = spark.read.parquet(f"{index.root}/meta").first()["width"]
    with batches_of(spark, 2000):
        rows = stored(assigned(vectors, index.centers, vec, embedding))
        grown = rows.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
        radius, sizes = index.radius.copy(), index.sizes.copy()
        for r in grown:
            radius[r["cell"]], sizes[r["cell"]] = max(radius[r["cell"]], r["far"]), sizes[r["cell"]] + r["n"]
        # the wider radius first: it only makes searches read more
        table = [(c, x.tolist(), float(radius[c]), int(sizes[c])) for c, x in enumerate(index.centers)]
        spark.createDataFrame(table, "cell int, center array<double>, radius double, n long").coalesce(1).write.mode("append").parquet(f"{index.root}/centers")
        packed(rows, {"id": "i8"}, index.centers.shape[1], width).write.mode("append").partitionBy("cell").parquet(f"{index.root}/lists")
    return Index(index.root, index.centers, radius, sizes, index.probes)


def _asked(queries: DataFrame, dimensions: int) -> DataFrame:
    """(query_id, v, exclude[, bound]) of queries (query_id, vector[, exclude][, bound]) that can be answered."""
    out = F.coalesce(F.col("exclude").cast("long"), F.lit(NONE)) if "exclude" in queries.columns else F.lit(NONE)
    rows = queries.where(F.col("vector").isNotNull() & (F.size("vector") == dimensions))
    return rows.select("query_id", F.col("vector").cast(kind_of(queries, "vector")).alias("v"), out.alias("exclude"), *(["bound"] if "bound" in queries.columns else []))


def probed(index: Index, queries: DataFrame, probes: int | None = None, skip: int = 0) -> DataFrame:
    """(cell, query_id, v, exclude): the cells that each query reads: its nearest ``probes`` ones, or where queries have a ``bound``
    (a distance), all but the nearest ``skip`` ones whose members may come within it."""
    centers, radius, live = index.centers, index.radius, index.sizes > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                if not len(part):
                    continue
                d = _distances(matrix(part.column("v"), len(part)), centers)
                d[:, ~live] = np.inf
                order = np.argsort(d, 1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(centers)), order.shape), 1)
                take = live & (rank < probes) if probes is not None else live & (rank >= skip) & (np.sqrt(d) - radius <= part.column("bound").to_numpy(zero_copy_only=False)[:, None] + 1e-9)
                row, cell = np.nonzero(take)
                for j in range(0, len(row), 4096):
                    own = part.take(pa.array(row[j : j + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[j : j + 4096].astype(np.int32)), *(own.column(c) for c in ("query_id", "v", "exclude"))], names=["cell", "query_id", "v", "exclude"])

    return _asked(queries, centers.shape[1]).mapInArrow(run, f"cell int, query_id long, v {kind_of(queries, 'vector')}, exclude long")


def lists(spark: SparkSession, index: Index, cells: list[int]) -> DataFrame:
    """The stored blocks of some cells; only their folders are read."""
    every = spark.read.schema("v binary, id binary, cell int").parquet(f"{index.root}/lists")
    return every.where(F.col("cell").isin(cells)) if len(cells) < index.cells else every


def scanned(index: Index, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance): of each query the k nearest in each cell that it reads."""
    spark = pairs.sparkSession
    dimensions = index.centers.shape[1]
    blocks = stored(packed(pairs, {"query_id": "i8", "exclude": "i8"}, dimensions).withColumnsRenamed({"v": "q"}))
    cells = [r[0] for r in blocks.select("cell").distinct().collect()]  # numbers of cells
    width = spark.read.parquet(f"{index.root}/meta").first()["width"]
    joined = lists(spark, index, cells).join(blocks, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            for q, d, ids in best.values():
                row, col = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(ids[row, col]), pa.array(d[row, col])], names=["query_id", "id", "distance"])
            best.clear()

        for b in batches:
            for i in range(len(b)):
                cell, v, ids, q, qid, without = (b.column(c)[i].as_py() for c in ("cell", "v", "id", "q", "query_id", "exclude"))
                if cell != now or sum(len(x[0]) for x in best.values()) > HELD:
                    yield from out()
                    now = cell
                x, own = np.frombuffer(v, f"f{width}").astype(np.float64).reshape(-1, dimensions), np.frombuffer(ids, np.int64)
                y, asked = np.frombuffer(q, np.float64).reshape(-1, dimensions), np.frombuffer(qid, np.int64)
                d = _distances(y, x)
                d[np.frombuffer(without, np.int64)[:, None] == own] = np.inf
                near = np.argpartition(d, k - 1, 1)[:, :k] if k < len(own) else np.broadcast_to(np.arange(len(own)), d.shape)
                gone = np.isinf(np.take_along_axis(d, near, 1))
                d = np.where(gone, np.inf, between(y, x[near]))
                at = own[near]
                held = best.get(qid)
                if held is not None:
                    d, at = np.hstack([held[1], d]), np.hstack([held[2], at])
                order = np.lexsort((at, np.round(d, 9)), 1)[:, :k]
                best[qid] = asked, np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)
        yield from out()

    with batches_of(spark, 256):
        return stored(joined.mapInArrow(run, "query_id long, id long, distance double"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    return found.withColumn("vector_rank", rank).where(F.col("vector_rank") <= k).withColumn("similarity", 1 - F.col("distance") / 2)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """As ``vectors.knn``, from the cells that queries (query_id, vector[, exclude]) probe: (query_id, id, distance, vector_rank,
    similarity). With as many probes as cells it is exact."""
    return ranked(scanned(index, probed(index, queries, probes or index.probes), k), k)


def exact(index: Index, queries: DataFrame, k: int, first: int = 2) -> DataFrame:
    """As ``search``, but every true neighbour: what the nearest cells give bounds which others are read."""
    near = scanned(index, probed(index, queries, first), k)
    kth = ranked(near, k).groupBy("query_id").agg(F.count("*").alias("n"), F.sqrt(F.max("distance")).alias("far"))
    bounded = queries.join(kth, "query_id", "left").withColumn("bound", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))))
    return ranked(near.unionByName(scanned(index, probed(index, bounded, skip=first), k)), k)
