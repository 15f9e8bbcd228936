"""Vectorised helpers that the operators of this subpackage share.

Texts arrive as Arrow batches. Each batch is cut into blocks of at most ``BLOCK_BYTES`` of UTF-8
(a longer text is a block of its own) and all word, line and shingle work of a block is done by
numpy passes over its bytes, so the memory of a task is bounded by the longest text, not by the
number of rows in a batch.

Words are known by 64-bit hashes: a polynomial over random byte values, finished by a bijective
mixer. Two different words of a corpus of n words share a hash with probability near n^2 / 2^65.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: Input bytes that a bucket of hashes stands for, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 24
#: Bits of a page of a bitmap, pages that the driver reads at a time, about, and bits that a task packs at a time.
PAGE_BITS, PAGES, POOL_BITS = 1 << 22, 4, 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2^64
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.RandomState(20240229).randint(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^0..p^n and p^-0..p^-n modulo 2^64; made once a process and grown by need."""
    have = _POW.get("p")
    if have is None or len(have) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        for name, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, _U)
            a[0] = 1
            _POW[name] = np.cumprod(a, dtype=_U)
    return _POW["p"], _POW["i"]


def byte_class(pattern: str) -> np.ndarray:
    """True for each byte that is part of a word. pattern: ``space`` (words are runs of anything but
    \\x20 and \\x09-\\x0D) or ``alnum`` (runs of digits, a-z and whatever lies beyond ASCII)."""
    t = np.zeros(256, bool)
    if pattern == "space":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    else:
        raise ValueError(f"unknown word pattern {pattern!r}")
    return t


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Block:
    """Some whole texts of one batch, as bytes. ``at``: the rows' byte offsets, one more than rows."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, lower: bool):
        self.batch, self.at, self.n = batch, at, len(at) - 1
        self.raw = data
        self.data = _LOWER[data] if lower else data

    def column(self, name: str) -> list:
        return self.batch.column(name).to_pylist()

    def text_bytes(self, row: int) -> bytes:
        return self.raw[self.at[row] : self.at[row + 1]].tobytes()

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (exclusive) of the maximal runs of member bytes inside each text, and the
        rows' offsets among them (one more than rows)."""
        m = member[self.data]
        n = len(m)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.n + 1, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[self.at] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, m[:-1]
        before[cut[:n]] = False
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, m[1:]
        after[cut[1:]] = False
        starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def prefix(self) -> np.ndarray:
        """Running polynomial of the bytes, for hashes of any span."""
        n = len(self.data)
        p, _ = _powers(n)
        c = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[self.data] * p[:n], dtype=_U, out=c[1:])
        return c

    def hashes(self, starts: np.ndarray, ends: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each span's bytes."""
        c = self.prefix() if c is None else c
        _, inv = _powers(len(self.data))
        return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def blocks(batches: Iterator[pa.RecordBatch], lower: bool = False, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts Arrow batches into blocks; a null text is an empty one."""
    for batch in batches:
        text = batch.column(column)
        text = text.cast(pa.large_string()) if text.type != pa.large_string() else text
        if text.null_count:
            text = text.fill_null("")
        _, off, data = text.buffers()
        if not len(text):
            continue
        off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            j = min(j, len(text))
            yield Block(batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i], lower)
            i = j


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; the last n - 1 positions have none."""
    if len(h) < n:
        return np.zeros(0, _U)
    out = np.zeros(len(h) - n + 1, _U)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
    return mix(out)


def long_grams(h: np.ndarray, n: int) -> np.ndarray:
    """As ``grams``, for long windows: one running polynomial instead of n passes."""
    if len(h) < n:
        return np.zeros(0, _U)
    p, inv = _powers(len(h))
    c = np.zeros(len(h) + 1, _U)
    np.cumsum(h * p[: len(h)], dtype=_U, out=c[1:])
    return mix((c[n:] - c[:-n]) * inv[: len(h) - n + 1])


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def inside(at: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n consecutive elements of one row start."""
    total = int(at[-1])
    if total < n:
        return np.zeros(0, np.int64)
    r = row_of(at)
    return np.flatnonzero(r[: total - n + 1] == r[n - 1 :])


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each position that lies in one of the spans at least."""
    d = np.zeros(length + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches between the JVM and Python of at most so many rows: with the default of 10,000 whole texts a batch
    takes tens of megabytes on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def free(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as make it a new one."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a session of one machine (``local``) that names none, as in tests, gets
    one of its own: on a cluster a folder of one machine would lose data, so that is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/notegrove-checkpoints-{os.getpid()}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Written as Parquet to the shared folder, a folder for each value of ``by``, and read again: lineage ends at files that
    outlive any executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/notegrove-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int:
    """Bytes of a frame: of files as the optimizer knows them; of a join or of local rows, of which it guesses, as counted in a pass
    over their texts."""
    plan = df._jdf.queryExecution().optimizedPlan()
    known, shape = int(str(plan.stats().sizeInBytes())), plan.toString()
    if known < 1 << 60 and "Relation [" in shape and "Join" not in shape:
        return known
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(F.sum(sum(texts, F.lit(8 * len(df.columns)).cast("long")))).first()[0] or 0)


def hash_buckets(df: DataFrame) -> int:
    """How many buckets to deal hashes of a frame into: several a partition, and so many that one has about BUCKET_BYTES of
    the frame, whatever the number of partitions."""
    n = partitions(df.sparkSession)
    return n * max(4, min(MOST_BUCKETS, input_bytes(df) // BUCKET_BYTES) // n)


def dealt(df: DataFrame) -> DataFrame:
    """Rows with a ``bucket``, a bucket in one partition and sorted by it (the JVM spills), for ``by_bucket``."""
    return df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one bucket after another, so that a task holds one bucket at a time."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        keys = b.column("bucket").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[i] != at:
                yield held
                held = []
            at = keys[i]
            held.append(b.slice(i, j - i))
    if held:
        yield held


def bits_for(n: int, least: int, most: int) -> int:
    """Bits of a bitmap that n keys fill to an eighth at most: a power of two between two bounds."""
    return max(least, min(most, 1 << (8 * max(n, 1) - 1).bit_length()))


def scatter(key: np.ndarray, n: int, columns: list[np.ndarray]) -> Iterator[tuple]:
    """(bucket, each column's bytes) for every bucket that some keys fall in; a packed row a bucket is
    what a task sends, in place of a row for each key."""
    bucket = ((key >> _U(24)) % _U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)):
        own = order[edges[k] : edges[k + 1]]
        yield int(k), *(c[own].tobytes() for c in columns)


def bitmap(df: DataFrame, bit: Column, bits: int) -> np.ndarray:
    """A bitmap over 0..bits-1 of the values of a long expression, as packed 64-bit words. Tasks send their bits packed by page
    and make the pages; the driver reads a few pages at a time, so it holds the bitmap itself and no row for a word of it."""
    size = min(bits, PAGE_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held = [], 0
        for b in batches:
            pool.append(b.column(0).drop_null().to_numpy(zero_copy_only=False))
            held += len(pool[-1])
            if held > POOL_BITS:
                yield by_page(pool)
                pool, held = [], 0
        if held:
            yield by_page(pool)

    def by_page(pool: list[np.ndarray]) -> pa.RecordBatch:
        at = np.unique(np.concatenate(pool))
        pages, first = np.unique(at // size, return_index=True)
        place = (at % size).astype(np.uint32)
        own = [place[i:j].tobytes() for i, j in zip(first, [*first[1:], len(at)], strict=True)]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(pages, pa.int32()), "at": pa.array(own, pa.binary())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_bucket(batches):
            page = np.zeros(size, bool)
            for x in (x for b in group for x in b.column("at").to_pylist()):
                page[np.frombuffer(x, np.uint32)] = True
            yield pa.RecordBatch.from_pydict({"bucket": group[0].column("bucket").slice(0, 1), "page": pa.array([np.packbits(page, bitorder="little").tobytes()], pa.binary())})

    sent = df.select(bit.alias("b")).mapInArrow(send, "bucket int, at binary")
    pages = dealt(sent).coalesce(max(1, bits // (PAGE_BITS * PAGES))).mapInArrow(fill, "bucket int, page binary")
    out = np.zeros(bits // 64, _U)
    for page in pages.toLocalIterator():
        out[page["bucket"] * (size // 64) :][: size // 64] = np.frombuffer(page["page"], _U)
    return out


def marked(bitmap_words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each position is set."""
    at = at.astype(_U)
    return ((bitmap_words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)).astype(bool)


def id_bit(ids: np.ndarray, bits: int) -> np.ndarray:
    """Position of an id in a bitmap, as ``id_bit_column`` gives it."""
    return (ids.astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(33)) % _U(bits)


def packed_ids(df: DataFrame, column: str, least: int = 1 << 23, most: int = 1 << 30) -> tuple[np.ndarray, int]:
    """(bitmap of hashed ids, its bits): 1 MB, or a byte for each row of a stored frame up to 128 MB. A false positive costs
    its user some work and never changes a result."""
    bits = bits_for(df.count(), least, most)

    def run(batches):
        for b in batches:
            ids = np.unique(b.column(0).drop_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"b": pa.array(np.unique(id_bit(ids, bits)).astype(np.int64))})

    return bitmap(df.select(F.col(column).cast("long")).mapInArrow(run, "b long"), F.col("b"), bits), bits
