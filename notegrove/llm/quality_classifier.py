"""Quality classifier by Bradley-Terry pairwise ranking (operator 8).

A document's merit is a linear function of features of its whole text (densities of symbols, marks and
repetition, letter and word statistics). It is learned from preference pairs, a document of label 1 over
one of label 0, by the logistic loss on the difference of their features (Newton steps with a ridge),
so the intercept cancels and only the ranking is learned. The threshold is the quantile of the training
scores at the share of label 0; scores are mapped to 0..1 so that it lies at ``CUT``.

The fit uses every labelled row outside the held-out fold: their features lie in buckets of about ``ROWS`` rows, and each row is in
``ROUNDS`` pairs at least with rows of the other label in its bucket; a label too rare for the number of buckets has its rows in several.
Each Newton step sums gradient and curvature over the buckets, a row of numbers a bucket, and the threshold is the exact quantile
of all training scores. Rows of the held-out fold are never among them, and neither labels, lang, source nor doc_id enter a score.

Edge cases: null and empty texts are scored by their (zero) features; a row without doc_id has no
label and is not held out; repeated rows each have a row; without labels of both kinds all scores
are 0.5; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm.common import Block, blocks, by_bucket, dealt, documents, free, stored
from notegrove.llm.quality_rules import Features, tally

PAIRS = 40_000
#: Labelled rows of a bucket, rows of the rarer label that a bucket gets at least, and pairs of each row of the more frequent one.
ROWS, RARE, ROUNDS = 16_384, 64, 2
FOLDS = 5
CUT = 0.3
RIDGE = 1.0
_N = 17


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_PIPE, _DIGIT, _MARK, _HIGH, _FEED = _flags(b"|"), _flags(b"0123456789"), _flags(b".,;:"), _flags(bytes(range(128, 256))), _flags(b"\n")


def features(b: Block) -> np.ndarray:
    """A row of ``_N`` numbers for each text."""
    f = Features(b)
    n = np.maximum(1, f.n_words).astype(float)
    chars = np.maximum(1, f.word_chars).astype(float)
    at, words = f.runs[2], f.words
    row = np.repeat(np.arange(b.n), np.diff(at))
    again = np.zeros(len(words), bool)
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    twice = np.bincount(row[again], minlength=b.n)
    mean = chars / n
    soft = lambda x: np.log1p(20 * x)  # noqa: E731  ratios matter most near nought
    x = np.stack(
        [
            soft(f.n_symbols / n),
            soft(f.n_bangs / n),
            soft(tally(b, _PIPE[b.data]) / n),
            soft(twice / n),
            soft(f.top_word / n) * (n >= 20),
            soft(f.n_upper / np.maximum(1, f.n_letters)),
            soft(f.n_dup_lines / np.maximum(1, f.n_lines)) * (f.n_dup_lines > 0),
            soft(f.n_repeat_words / n),
            soft(tally(b, _DIGIT[b.data]) / chars),
            soft(tally(b, _MARK[b.data]) / n),
            soft(tally(b, _HIGH[b.data]) / chars),
            np.log1p(f.n_words),
            mean * (f.n_words > 0),
            np.abs(mean - 5) * (f.n_words > 0),
            soft(tally(b, _FEED[b.data]) / n),
            (f.n_symbols > 0.5 * n).astype(float),
            (f.n_bangs > 0.3 * n).astype(float),
        ],
        1,
    )
    return x


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float
    cut: float = CUT

    def score(self, x: np.ndarray) -> np.ndarray:
        merit = ((x - self.mean) / self.scale) @ self.weight - self.threshold
        z = self.slope * merit + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss of pairs' differences."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return d.T @ (p - 1), (d * (p * (1 - p))[:, None]).T @ d


def _minimum(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, ridge: float) -> np.ndarray:
    """The weights of the least loss by Newton steps; sums gives gradient and curvature, without the ridge, at weights."""
    w = np.zeros(n)
    for _ in range(25):
        grad, hess = sums(w)
        step = np.linalg.solve(hess + ridge * np.eye(n), grad + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _ranker(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, low: float, high: float, top: float, cut: float) -> Ranker:
    """The ranker whose threshold lies between two scores; top: the highest."""
    threshold = (low + high) / 2
    return Ranker(mean, scale, w, threshold, 4 / max(1e-9, top - threshold) * 1.5, cut)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, cut: float = CUT, seed: int = 11) -> Ranker | None:
    """A ranker from features and labels at hand, with pairs drawn at random; None without labels of both kinds."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    rng = np.random.RandomState(seed)
    d = z[good[rng.randint(0, len(good), pairs)]] - z[bad[rng.randint(0, len(bad), pairs)]]
    w = _minimum(lambda w: _sums(d, w), x.shape[1], ridge)
    s = np.sort(z @ w)
    k = min(max(1, len(bad)), len(s) - 1)
    return _ranker(mean, scale, w, float(s[k - 1]), float(s[k]), float(s[-1]), cut)


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def paired(y: np.ndarray, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Places of label 1 and of label 0 that make the pairs of a bucket: in each round every row, those of the rarer label repeated."""
    rng = np.random.RandomState(seed % (1 << 32))
    kinds = [np.flatnonzero(y == 1), np.flatnonzero(y == 0)]
    if not min(map(len, kinds)):
        return kinds[0][:0], kinds[1][:0]
    most = max(map(len, kinds))
    good, bad = (np.concatenate([np.resize(rng.permutation(k), most) for _ in range(rounds)]) for k in kinds)
    return good, bad


def _bucketed(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(bucket, y, own, x), a row a bucket, from (d, y, x) rows, distinct in d and y. own: 0 for what a row of a rare label
    is in a bucket beside its first."""
    n = max(1, -(-sum(counts.values()) // ROWS))
    rare = min(counts, key=lambda k: (counts[k], k))
    copies = min(n, max(1, -(-RARE * n // counts[rare])))
    first = F.pmod(F.xxhash64("d"), F.lit(n))
    at = F.sequence(F.lit(0), F.when(F.col("y") == rare, copies - 1).otherwise(0))
    many = rows.select("d", "y", "x", first.alias("first"), F.explode(at).alias("j")).select(((F.col("first") + F.col("j")) % n).alias("bucket"), "d", "y", "x", (F.col("j") == 0).cast("int").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            t = pa.Table.from_batches(held)
            d, y, own = (t.column(c).to_numpy() for c in ("d", "y", "own"))
            order = np.lexsort((y, d))  # the same whatever the order of the rows that came
            x = np.frombuffer(b"".join(t.column("x").to_pylist())).reshape(len(d), -1)[order]
            cols = {"y": y[order].astype(np.int8), "own": own[order].astype(np.int8), "x": x}
            yield pa.RecordBatch.from_pydict({"bucket": t.column("bucket")[:1].combine_chunks(), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in cols.items()}})

    return stored(dealt(many).mapInArrow(run, "bucket long, y binary, own binary, x binary"))


def _each(buckets: DataFrame, f: Callable[[int, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[list[np.ndarray]]:
    """What f(bucket, y, own, x) gives of each bucket, a few arrays of features' numbers, in the order of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                k, y, own, x = (b.column(c)[i].as_py() for c in ("bucket", "y", "own", "x"))
                out = f(k, np.frombuffer(y, np.int8), np.frombuffer(own, np.int8) == 1, np.frombuffer(x).reshape(len(y), -1))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "v": pa.array([[a.astype(float).tobytes() for a in out]], pa.list_(pa.binary()))})

    got = sorted(buckets.mapInArrow(run, "bucket long, v array<binary>").collect(), key=lambda r: r["bucket"])
    return [[np.frombuffer(a) for a in r["v"]] for r in got]


def _neighbours(values: DataFrame, k: int, bins: int = 1024) -> tuple[float, float, float]:
    """(the score of place k - 1 from 0 in order, that of place k, the highest) of (s, n) rows, n times each; 0 < k < all. Every
    round reads counts of so many ranges and goes into the one that holds both."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    top, before = high, 0
    while low < high:
        at = F.least(F.floor((F.col("s") - low) / (high - low) * bins), F.lit(bins - 1))
        ranges = values.where(F.col("s").between(low, high)).groupBy(at.alias("b")).agg(F.sum("n").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
        ranges.sort(key=lambda r: r["b"])
        for i, r in enumerate(ranges):
            if before + r["n"] > k:
                low, high = r["low"], r["high"]
                break
            before += r["n"]
            if before == k:
                return r["high"], ranges[i + 1]["low"], top
    return low, low, top


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", ridge: float = RIDGE, cut: float = CUT) -> Ranker | None:
    """Fits on all labelled rows outside the held-out fold; documents that share a doc_id count as one."""
    key = F.col("doc_id")
    kinds = labels.where(key.isNotNull() & (fold(key) != 0) & F.col(label).cast("int").isin(0, 1)).select(key.cast("long").alias("d"), F.col(label).cast("int").alias("y")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_pydict({"d": b.batch.column("d"), "x": pa.array([r.tobytes() for r in features(b)], pa.binary())})

    got = docs.where(key.isNotNull() & (fold(key) != 0)).select(key.cast("long").alias("d"), F.col(text).alias("text")).mapInArrow(run, "d long, x binary")
    rows = stored(got.groupBy("d").agg(F.min("x").alias("x")).join(kinds, "d").select("d", "y", "x"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return None
    buckets = _bucketed(rows, counts)

    def moments(k: int, y: np.ndarray, own: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        x = x[own]
        mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        return [np.array([len(x)]), mean, ((x - mean) ** 2).sum(0)]

    n, means, off = (np.array(v) for v in zip(*_each(buckets, moments), strict=True))
    mean = (n * means).sum(0) / n.sum()
    scale = np.sqrt((off + n * (means - mean) ** 2).sum(0) / n.sum()) + 1e-9

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(k: int, y: np.ndarray, own: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
            z = (x - mean) / scale
            good, bad = paired(y, k)
            return list(_sums(z[good] - z[bad], w))

        grads, curves = zip(*_each(buckets, part), strict=True)
        return np.sum(grads, 0), np.sum(curves, 0).reshape(len(w), len(w))

    w = _minimum(sums, len(mean), ridge)

    def merits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, x in zip(b.column("own").to_pylist(), b.column("x").to_pylist(), strict=True):
                own = np.frombuffer(own, np.int8) == 1
                s, times = np.unique(((np.frombuffer(x).reshape(len(own), -1)[own] - mean) / scale) @ w, return_counts=True)
                yield pa.RecordBatch.from_pydict({"s": pa.array(s), "n": pa.array(times.astype(np.int64))})

    values = stored(buckets.mapInArrow(merits, "s double, n long"))
    return _ranker(mean, scale, w, *_neighbours(values, min(max(1, counts[0]), sum(counts.values()) - 1)), cut)


def scored(docs: DataFrame, ranker: Ranker | None, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every row, under ``name``; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(ranker)
    schema, read = docs.select(*keep).schema.add(name, "double"), free("text", [*keep, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, column=read):
            s = np.full(b.n, 0.5) if held.value is None else held.value.score(features(b))
            yield pa.RecordBatch.from_arrays([*(b.batch.column(c) for c in keep), pa.array(s)], names=[*keep, name])

    return docs.select(*keep, F.col(text).alias(read)).mapInArrow(run, schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ranker = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, ranker, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
