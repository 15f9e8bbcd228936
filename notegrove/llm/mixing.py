"""Mixing sources to target weights by balanced sampling, the cube method (operator 9).

Sources weigh 5, 2, 1, repeating, in code-point order (null last) and share all words by weight; a
target stops at ``LIMIT`` times its source's size and the excess is shared again among the others.
A source whose target is f times its size takes each document floor(f) times, and once more with the
inclusion probability f - floor(f).

The extra takes are drawn by the cube method: the vector of inclusion probabilities moves
inside the unit cube along directions of the null space of the constraints (the number of
documents and the number of words), which keeps both totals, until coordinates reach 0 or 1. A step
of the flight phase takes three undecided documents, whose null space under the two constraints
is a line, and settles one at least. Flights run block by block in parallel; a block leaves at most
two documents undecided, which meet those of other blocks in the next, coarser round, until one
small block of each source is left. Its landing phase drops the word constraint, then settles the last one by
the distance of the words taken from their target.

Draws come from hashes of doc_id, size, a number among equal rows and a seed, so reruns agree whatever the partitioning.

Edge cases: a null or empty text has size 0 and takes 0 words; a null source is a source; rows without doc_id and repeated
rows are drawn on their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrove.llm.common import blocks, byte_class, documents, free, partitions, stored

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK = 4096
#: Sources whose table is broadcast; of more sources, those with more than 1 of SHARE rows.
FEW_SOURCES, SHARE = 100_000, 1000
_WORD = byte_class("space")


def sizes(docs: DataFrame, text: str = "text", mark: str | None = None) -> DataFrame:
    """doc_id, source, size (words of the text) and mark (0, if no column is named) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.batch.column("doc_id"), b.batch.column("source"), pa.array(np.diff(b.runs(_WORD)[2]), pa.int64()), b.batch.column("mark")], names=["doc_id", "source", "size", "mark"])

    marked = F.lit(0).cast("long") if mark is None else F.col(mark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).alias("text"), marked.alias("mark")).mapInArrow(run, "doc_id long, source string, size long, mark long")


def with_size(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """The rows, with their size as a last column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, column=text):
            yield b.batch.append_column(name, pa.array(np.diff(b.runs(_WORD)[2]), pa.int64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def source_table(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, n, source_size, target, hot), a row a source, from (source, size, c) with c equal rows each. hot: with more than
    1 of ``SHARE`` rows. Sources are numbered by a range sort, and the level up to which their targets fill is found by sums
    over the table, so only a row a partition and the sums reach the driver."""
    spark = rows.sparkSession
    key = F.col("source").asc_nulls_last()
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"), F.sum("c").alias("n"))
    part = F.shiftright("id", 33)  # of these ids, the lower 33 bits number the rows of a partition
    order = stored(totals.repartitionByRange(partitions(spark), key).sortWithinPartitions(key).withColumn("id", F.monotonically_increasing_id()))
    before, at = [], 0
    for k, n in sorted(map(tuple, order.groupBy(part).count().collect())):
        before.append((k, at))
        at += n
    first = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    nth = F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    table = stored(order.join(first, part == F.col("part")).select("source", "n", "source_size", weight.alias("weight")))
    total, rows_ = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cap, level, known = F.col("source_size") * limit, Fraction(0), -1
    while True:
        # the share of each weight at this level
        share = F.coalesce(*(F.when(F.col("weight") == w, F.lit(float(level * w))) for w in sorted(set(weights))))
        full = cap < share
        got = table.agg(F.count_if(full), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if got[0] == known or not got[2]:
            break
        level, known = Fraction(total - got[1]) / Fraction(got[2]), got[0]
    return table.select("source", "n", "source_size", F.when(full, cap.cast("double")).otherwise(share).alias("target"), (F.col("n") * SHARE > rows_).alias("hot"))


def _of_source(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """The rows with their source's columns. A table of few sources is broadcast; of more, only the hot ones, of which there are
    at most ``SHARE``, and the rows of the others are joined by their source."""
    side, on = table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    if few:
        return rows.join(F.broadcast(side), on).drop("s", "hot")
    hot = side.where("hot")
    rest = rows.join(F.broadcast(hot.select("s")), on, "left_anti").join(side, on)
    return rows.join(F.broadcast(hot), on).unionByName(rest).drop("s", "hot")


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Moves the probabilities with the sums of p and of p * size kept; at most two stay inside (0, 1)."""
    p = p.copy()
    live: list[int] = []
    eps = 1e-9
    todo = iter(np.flatnonzero((p > eps) & (p < 1 - eps)).tolist())
    step = 0
    while True:
        while len(live) < 3:
            nxt = next(todo, None)
            if nxt is None:
                return p
            live.append(nxt)
        i, j, k = live
        a, b, c = float(size[i]), float(size[j]), float(size[k])
        u = (b - c, c - a, a - b)  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(live, u, strict=True) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(live, u, strict=True) if v)
        t = up if draw[step % len(draw)] * (up + down) < down else -down
        for x, v in zip(live, u, strict=True):
            p[x] = min(1.0, max(0.0, p[x] + t * v))
        live = [x for x in live if eps < p[x] < 1 - eps]
        step += 1


def landing(p: np.ndarray, size: np.ndarray, wanted: float) -> np.ndarray:
    """Settles the few probabilities left so that the words taken come as near the wanted number as can be."""
    p = p.copy()
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    p[p >= 1 - 1e-9], p[p <= 1e-9] = 1.0, 0.0
    base = float(np.dot(p, size) - np.dot(p[open_], size[open_]))
    best = min(range(1 << len(open_)), key=lambda m: (abs(base + sum(float(size[x]) for i, x in enumerate(open_) if m >> i & 1) - wanted), m))
    for i, x in enumerate(open_):
        p[x] = float(best >> i & 1)
    return p


_COLUMNS = "doc_id long, source string, size long, mark long, nth long, p double, u long, done boolean"


def _copies(rows: DataFrame, count: str) -> DataFrame:
    """A row, numbered ``nth`` from 0, for each of ``count`` equal rows; made block by block, so that no array grows
    with the count."""
    many = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(BLOCK).cast("long"))))
    return many.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + BLOCK, F.col(count)) - 1))).drop("from", count)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 7, text: str = "text", mark: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row, and its mark where a long column is named, which must not
    be null. Texts are read once; after that only sizes travel. Rows of equal doc_id, source, size and mark are alike: they
    are counted first and numbered, so that they fall into different blocks however many they are."""
    spark = docs.sparkSession
    alike = ["doc_id", "source", "size", "mark"]
    rows = stored(sizes(docs, text, mark).groupBy(*alike).agg(F.count("*").alias("c")))
    table = stored(source_table(rows, weights, limit))
    sources, most = table.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    few = sources <= FEW_SOURCES
    of = _of_source(rows, table, few)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of = of.withColumn("times", F.floor(factor + 1e-12).cast("long")).withColumn("p", F.greatest(F.lit(0.0), factor - F.col("times")))
    of = _copies(of, "c")

    def fly(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["u", "doc_id", "size", "mark", "nth"], kind="stable", ignore_index=True)
            size, p0 = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64)
            draw = (pdf["u"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
            draw = (draw * 104729.0 + 0.5) % 1.0
            p = flight(p0, size, draw)
            if last:
                p = landing(p, size, float(np.dot(p0, size)))
            done = (p <= 1e-9) | (p >= 1 - 1e-9)
            return pdf.assign(p=np.where(done, np.round(p), p), done=done)[["doc_id", "source", "size", "mark", "nth", "p", "u", "done"]]

        return run

    u = F.xxhash64("doc_id", "size", *([] if mark is None else ["mark"]), "nth", F.lit(seed))
    open_ = of.where((F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)).select(*alike, "nth", "p", u.alias("u"), F.lit(False).alias("done"), "n")
    settled = []
    width = most
    open_ = open_.withColumn("cells", F.ceil(F.col("n") / BLOCK).cast("long")).drop("n")
    while True:
        last = width <= BLOCK
        cell = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("u", F.lit(len(settled))), F.greatest(F.col("cells"), F.lit(1).cast("long")))
        step = open_.withColumn("cell", cell)
        flown = stored(step.drop("cells").groupBy("source", "cell").applyInPandas(fly(last), _COLUMNS))
        settled.append(flown.where("done"))
        if last:
            break
        width = -(-width // BLOCK) * 2
        open_ = _of_source(flown.where("not done"), table.select("source", "n", "hot"), few)
        open_ = open_.withColumn("cells", F.ceil(F.lit(float(2 ** len(settled))) * F.col("n") / F.lit(float(BLOCK ** (len(settled) + 1)))).cast("long")).drop("n")
    drawn = settled[0]
    for s in settled[1:]:
        drawn = drawn.unionByName(s)
    e = drawn.where("p > 0.5").select(F.col("doc_id").alias("d2"), F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("mark").alias("m2"), F.col("nth").alias("n2"), F.lit(1).alias("extra"))
    same = (F.col("size") == F.col("z2")) & (F.col("mark") == F.col("m2")) & (F.col("nth") == F.col("n2"))
    out = of.join(e, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("source").eqNullSafe(F.col("s2")) & same, "left")
    base = F.when(F.col("p") >= 1 - 1e-9, 1).otherwise(0)
    taken = F.col("size") * (F.col("times") + base + F.coalesce("extra", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *([] if mark is None else ["mark"]))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 7, text: str = "text") -> DataFrame:
    """The rows that the mix takes words of, with their columns and size, source_size, target and taken (underscores before a
    name that is taken). Every row has the words of its own: rows of equal doc_id, source and text are numbered, and as many of them
    as the mix drew once more take their size more. Texts are shuffled once, by row."""
    names = {c: free(c, docs.columns) for c in ("size", "source_size", "target", "taken")}
    key, ident, source, nth, low, more = (free(c, [*docs.columns, *names.values()]) for c in ("key", "ident", "from", "nth", "low", "more"))
    other = [c for c, kind in docs.dtypes if c not in ("doc_id", "source", text) and "map<" not in kind and kind not in ("void", "variant")]
    marked = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col(text), F.lit(""))))
    keys = [key, names["size"], ident, source]
    whole = lambda df: df.withColumns({ident: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), source: F.coalesce(F.col("source").cast("string"), F.lit(""))})
    plan = whole(mixed(marked, weights, limit, seed, text, key).withColumnsRenamed({"mark": key, "size": names["size"]})).groupBy(*keys)
    plan = plan.agg(F.max("source_size").alias(names["source_size"]), F.max("target").alias(names["target"]), F.min("taken").alias(low), (F.sum("taken") - F.count("*") * F.min("taken")).alias(more))
    plan = plan.where((F.col(names["size"]) > 0) & (F.col(low) + F.col(more) > 0))
    rows = whole(with_size(marked, text, names["size"])).where(F.col(names["size"]) > 0)
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*other) if other else F.lit(0))))
    # merged at every size: what the mix takes grows with the input
    out = rows.join(plan.hint("merge"), keys)
    extra = F.when(F.col(nth) * F.col(names["size"]) <= F.col(more), F.col(names["size"])).otherwise(0)
    out = out.withColumn(names["taken"], F.col(low) + extra).where(F.col(names["taken"]) > 0)
    return out.select(*docs.columns, *names.values())


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
