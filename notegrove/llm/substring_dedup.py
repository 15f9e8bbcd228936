"""Substring deduplication by seed and extend (operator 6).

Seeds. Each document's ``SEED``-word shingles are winnowed: of every ``length - SEED + 1``
consecutive shingles the one with the smallest hash is an anchor. Two equal runs of ``length`` words
hold equal shingles, so they choose the same anchor at the same offset: no repeat of the threshold
length can be missed.

Join. Anchors meet by hash. A first round counts the bare anchors; those of one document only, most
of all, are dropped by a bitmap with a bit for some bytes of input (between the bounds of ``ANCHOR_BITS``; a false positive is only
work, and a bitmap that is full drops nothing).

Extend. A second round brings the windows of ``length`` words that chose an anchor that may repeat:
they are its possible extensions to both sides. An occurrence is extended as far as a smaller doc_id
has the same words, by comparing each extension with the smallest doc_id that has it. No pairs are formed,
so a passage in n documents costs n entries and not n^2. Extensions that hold merge into maximal
repeats, which are the spans to remove.

Hot passages. A task settles what it can: of the occurrences of a window among the texts that it holds,
all but those of the smallest doc_id are repeats already, and only one goes on. A passage in a third
of all documents so sends one entry a task, not one a document. Entries travel packed, one row from a
task to each bucket of anchor hashes; the number of buckets follows the input's size, and a task holds one at a time.

Edge cases: null and short texts have no windows and stay whole; a row without doc_id comes neither
before nor after others and stays whole; rows of one doc_id do not remove one another (rows are known
by doc_id and content); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm.common import Block, bitmap, bits_for, blocks, by_bucket, byte_class, covered, dealt, documents, grams, hash_buckets, id_bit, input_bytes, long_grams, marked, packed_ids, row_of, scatter, stored

LENGTH = 50
SEED = 20
#: Least and most bits of the anchors' bitmap, and the input bytes that stand for one repeated anchor when it is sized.
ANCHOR_BITS = (1 << 25, 1 << 29)
ANCHOR_BYTES = 128
POOL_WINDOWS = 400_000
_U = np.uint64
_WORD = byte_class("space")


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest (leftmost on ties) of each w consecutive values."""
    n = len(v) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    idx, span = np.arange(len(v)), 1
    while span * 2 <= w:
        a, b = idx[:-span], idx[span:]
        idx = np.where(v[b] < v[a], b, a)
        span *= 2
    a, b = idx[:n], idx[w - span : w - span + n]  # two windows of a power of two cover any window
    return np.where(v[b] < v[a], b, a)


def anchored(b: Block, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each window of ``length`` words inside one text: its row, its place in the text, its hash and
    the hash of the anchor that it chose."""
    starts, ends, at = b.runs(_WORD)
    if len(starts) < length:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(_U), z.astype(_U)
    h = b.hashes(starts, ends)
    row = row_of(at)
    pos = np.flatnonzero(row[: len(h) - length + 1] == row[length - 1 :])
    s = grams(h, seed)
    return row[pos], pos - at[row[pos]], long_grams(h, length)[pos], s[sliding_min(s, length - seed + 1)[pos]]


def content(b: Block) -> np.ndarray:
    """Hash of each whole text."""
    return b.hashes(b.at[:-1], b.at[1:])


def _binary(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    first = pa.array([r[0] for r in rows], pa.int32())
    return pa.RecordBatch.from_arrays([first, *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, len(names)))], names=names)


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, content, spans): for each document with repeats its doc_id, the hash of its text and the words to
    remove, as packed pairs (first, after the last) of 32-bit word positions."""
    spark = docs.sparkSession
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    n, bits = hash_buckets(source), bits_for(input_bytes(source) // ANCHOR_BYTES, *ANCHOR_BITS)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held = [], 0
        for b in blocks(batches):
            row, _, _, a = anchored(b, length, seed)
            if len(a):
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
                pool.append(a[new])
                held += len(pool[-1])
            if held > POOL_WINDOWS:
                yield send(pool)
                pool, held = [], 0
        if pool:
            yield send(pool)

    def send(pool: list[np.ndarray]) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(pool), return_counts=True)
        h = np.repeat(h, np.minimum(count, 2))  # twice is enough to be known as repeated
        return _binary(list(scatter(h, n, [h])), ["bucket", "a"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_bucket(batches):
            h = np.sort(np.concatenate([np.frombuffer(x, _U) for b in group for x in b.column("a").to_pylist()]))
            often = np.unique(h[1:][h[1:] == h[:-1]] % _U(bits)).astype(np.int64)
            for i in range(0, len(often), 100_000):
                yield pa.RecordBatch.from_pydict({"b": often[i : i + 100_000]})

    sent = dealt(source.mapInArrow(anchors, "bucket int, a binary"))
    held = spark.sparkContext.broadcast(bitmap(sent.mapInArrow(shared, "b long"), F.col("b"), bits))
    fields = ["bucket", "done", "k", "content", "pos", "len", "w"]

    def extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, size = [], 0
        for b in blocks(batches):
            row, pos, w, a = anchored(b, length, seed)
            if not len(row):
                continue
            maybe = marked(held.value, a % _U(bits))
            if maybe.any():
                ids, marks = b.batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64), content(b)
                row = row[maybe]
                pool.append((ids[row], marks[row], pos[maybe], w[maybe], a[maybe]))
                size += len(row)
            if size > POOL_WINDOWS:
                yield settle(pool)
                pool, size = [], 0
        if pool:
            yield settle(pool)

    def settle(pool: list[tuple]) -> pa.RecordBatch:
        k, mark, pos, w, a = (np.concatenate(x) for x in zip(*pool, strict=True))
        order = np.lexsort((k, w))
        sw, sk = w[order], k[order]
        head = np.concatenate([[True], sw[1:] != sw[:-1]])
        least = sk[np.flatnonzero(head)][np.cumsum(head) - 1]
        later = np.zeros(len(k), bool)
        later[order] = sk > least
        # of equal occurrences of the smallest doc_id all go on: a text may hold a window twice
        out = []
        for own, done in ((np.flatnonzero(later), b"1"), (np.flatnonzero(~later), b"0")):
            if not len(own):
                continue
            x, y, z = k[own], mark[own], pos[own]
            bucket = ((a[own] >> _U(24)) % _U(n)).astype(np.int64)
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1] + 1) | (bucket[1:] != bucket[:-1])])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(own)))
            to = bucket[first] if done == b"0" else (y[first] >> _U(24)).astype(np.int64) % n
            by = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[by], np.arange(n + 1))
            for q in np.flatnonzero(np.diff(edge)).tolist():
                runs = by[edge[q] : edge[q + 1]]
                if done == b"0":
                    s = size[runs]
                    take = np.repeat(first[runs], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                    windows = w[own][take].tobytes()
                else:
                    windows = b""
                f = first[runs]
                out.append((q, done, x[f].tobytes(), y[f].tobytes(), z[f].astype(np.int32).tobytes(), size[runs].astype(np.int32).tobytes(), windows))
        return _binary(out, fields)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_bucket(batches):
            yield from one(group)

    def one(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, found = [], []
        for b in group:
            for done, *rest in zip(*(b.column(c).to_pylist() for c in fields[1:]), strict=True):
                got = [np.frombuffer(x, t) for x, t in zip(rest, (np.int64, _U, np.int32, np.int32, _U), strict=True)]
                (found if done == b"1" else open_).append(got)
        parts = [[np.concatenate(x) for x in zip(*(g[:4] for g in found), strict=True)]] if found else []
        if open_:
            k, mark, pos, size, w = (np.concatenate(x) for x in zip(*open_, strict=True))
            doc = np.repeat(k, size)
            order = np.lexsort((doc, w))
            sw, sd = w[order], doc[order]
            head = np.concatenate([[True], sw[1:] != sw[:-1]])
            least = sd[np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.zeros(len(w), bool)
            later[order] = sd > least
            run = np.repeat(np.arange(len(k)), size)
            place = np.repeat(pos, size) + np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            run, place = run[later], place[later]
            if len(run):
                new = np.concatenate([[True], (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)])
                first = np.flatnonzero(new)
                parts.append([k[run[first]], mark[run[first]], place[first].astype(np.int32), np.diff(np.append(first, len(run))).astype(np.int32)])
        if not parts:
            return
        k, mark, pos, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((mark, k))
        k, mark, pos, size = k[order], mark[order], pos[order], size[order]
        pairs = np.stack([pos, pos + size - 1 + length], 1).astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (mark[1:] != mark[:-1])]))
        data, edges = pairs.tobytes(), np.append(first, len(k)) * 8
        spans = [data[edges[i] : edges[i + 1]] for i in range(len(first))]
        for i in range(0, len(first), 20_000):
            f = first[i : i + 20_000]
            yield pa.RecordBatch.from_pydict({"k": pa.array(k[f]), "content": pa.array(mark[f].view(np.int64)), "spans": pa.array(spans[i : i + 20_000], pa.binary())})

    schema = "bucket int, done binary, k binary, content binary, pos binary, len binary, w binary"
    parts = dealt(source.mapInArrow(extensions, schema)).mapInArrow(extend, "k long, content long, spans binary")
    return parts.groupBy("k", "content").agg(F.collect_list("spans").alias("spans"))


def kept_words(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_removed, kept_sha256 and kept: the words that stay, joined by one space. The
    text travels only for documents that may have a repeat."""
    spark = docs.sparkSession
    found = stored(repeats(docs, length, seed, text, key))
    ids_, bits = packed_ids(found, "k")
    held = spark.sparkContext.broadcast(ids_)
    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    out = "k long, content long, n_words long, sha string, text string"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            mark = content(b)
            ids = b.column("k")
            maybe = [i is not None and bool(marked(held.value, id_bit(np.array([i]), bits))[0]) for i in ids]
            count = np.diff(b.runs(_WORD)[2])
            sha, texts = [], []
            for r in range(b.n):
                raw = b.text_bytes(r)
                words = None if maybe[r] else b" ".join(raw.split())
                sha.append(None if words is None else hashlib.sha256(words).hexdigest())
                texts.append(raw.decode() if words is None else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(mark.view(np.int64)), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], names=["k", "content", "n_words", "sha", "text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_words", "sha", "text", "spans")), strict=True)
            removed, shas = [], []
            for n_words, sha, raw, spans in rows:
                gone = np.zeros(n_words, bool)
                if spans:
                    p = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
                    gone = covered(n_words, p[:, 0], p[:, 1])
                if raw is not None:
                    words = np.array(raw.encode().split(), object)
                    sha = hashlib.sha256(b" ".join(words[~gone].tolist())).hexdigest()
                removed.append(int(gone.sum()))
                shas.append(sha)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=[key, "n_words", "n_removed", "kept_sha256"])

    joined = source.mapInArrow(split, out).join(found, ["k", "content"], "left").select("k", "n_words", "sha", "text", "spans")
    return joined.mapInArrow(finish, f"{key} long, n_words long, n_removed long, kept_sha256 string")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return kept_words(documents(spark, sf_dir))
