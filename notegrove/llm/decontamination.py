"""Benchmark decontamination by an FM-index per training shard (operator 5).

The test side is cut into windows of ``n`` words. Each task takes the texts that it reads as shards
and builds for each an FM-index: a suffix array over its words, the Burrows-Wheeler transform in a
wavelet tree, and suffix positions sampled every ``SAMPLE`` text positions. All windows are searched
backward at once through wavelet-tree ranks; the rows of the resulting ranges walk back to sampled
positions, which gives the places that occur; overlapping places merge into removal spans.

The shard's alphabet is the test side's vocabulary. Every other word is a separator, which no window
holds, so stretches between separators that are shorter than the shortest window cannot hold one and
are left out of the index; that changes no answer.

The test side is read in blocks of about ``ITEM_BLOCK`` windows, so that what a task or the driver holds of it is
bounded; with several blocks, the texts pass once through each, a stage a block, and the spans and items
found so far travel along, without a shuffle. Between two blocks the rows are written to the shared folder.

Edge cases: null texts have no words; an item without words has no window; equal items are all
reported; repeated documents, and documents that share a doc_id, each have a row of their own; extra columns are ignored; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrove.llm.common import blocks, byte_class, covered, documents, row_of, spans_of, stored

WINDOW = 10
SAMPLE = 8
ITEM_BLOCK = 1_000_000
_WORD = byte_class("alnum")


class Wavelet:
    """Wavelet tree of a sequence of symbols below 2^bits, one bit vector a level, with prefix counts
    (levels are stored as in a wavelet matrix: zeros first, then ones)."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (seq >> k) & 1
            c = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=c[1:])
            self.levels.append(c)
            self.zeros.append(len(seq) - int(c[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(i), i
        for k, c, z in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros, strict=True):
            one = ((symbol >> k) & 1).astype(bool)
            lo = np.where(one, z + c[lo], lo - c[lo])
            hi = np.where(one, z + c[hi], hi - c[hi])
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    # rank = index of the first suffix of each group of ties in the order
    srt = rank[order]
    head = np.flatnonzero(np.concatenate([[True], srt[1:] != srt[:-1]]))
    size = np.diff(np.append(head, n))
    rank[order] = np.repeat(head, size)
    open_ = np.repeat(size > 1, size)
    while open_.any():
        slots = np.flatnonzero(open_)
        suf = order[slots]
        nxt = np.where(suf + k < n, rank[np.minimum(suf + k, n - 1)], -1)
        first = rank[suf]
        by = np.lexsort((nxt, first))
        suf, nxt, first = suf[by], nxt[by], first[by]
        order[slots] = suf
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (nxt[1:] != nxt[:-1])])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(slots)))
        rank[suf] = np.repeat(slots[head], size)
        open_ = np.zeros(n, bool)
        open_[slots] = np.repeat(size > 1, size)
        k *= 2
    return order


class FMIndex:
    """Over a sequence of symbols below sigma, in which 1 separates and the one 0 ends."""

    def __init__(self, text: np.ndarray, sigma: int):
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.tree = Wavelet(bwt, max(1, int(sigma).bit_length()))
        self.bwt = bwt
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.marked = sa % SAMPLE == 0
        self.sampled = sa[self.marked]
        self.marks_before = np.concatenate([[0], np.cumsum(self.marked)])

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each pattern; patterns are right-aligned in a padded matrix."""
        m, w = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for k in range(w):
            live = np.flatnonzero((k < lengths) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, w - 1 - k]
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of these rows: steps back until a sampled suffix."""
        rows, out, steps, live = rows.copy(), np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            done = self.marked[rows[live]]
            out[live[done]] = self.sampled[self.marks_before[rows[live[done]]]] + steps
            live = live[~done]
            c = self.bwt[rows[live]]
            rows[live] = self.less[c] + self.tree.rank(c, rows[live])
            steps += 1
        return out


class Windows:
    """The windows of some items, as symbols of their own vocabulary."""

    def __init__(self, items: list[tuple], n: int):
        batch = pa.RecordBatch.from_pydict({"text": pa.array([t or "" for _, t in items], pa.string())})
        self.ids = [i for i, _ in items]
        rows: dict[tuple, set[int]] = {}
        words: list[np.ndarray] = []
        base = 0
        for b in blocks(iter([batch]), lower=True):
            starts, ends, at = b.runs(_WORD)
            h = b.hashes(starts, ends)
            words.append(h)
            for r in range(b.n):
                w = h[at[r] : at[r + 1]]
                for k in range(max(0, len(w) - n) + 1 if len(w) else 0):
                    rows.setdefault(tuple(w[k : k + n].tolist()), set()).add(base + r)
            base += b.n
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.sigma = len(self.vocabulary) + 2
        self.lengths = np.array([len(k) for k in rows], np.int64)
        self.matrix = np.zeros((len(rows), n), np.int64)
        for i, k in enumerate(rows):
            self.matrix[i, n - len(k) :] = np.searchsorted(self.vocabulary, np.array(k, np.uint64)) + 2
        self.items = [sorted(v) for v in rows.values()]
        self.shortest = int(self.lengths.min()) if len(rows) else 0

    def find(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first word, word after the last) of every occurrence in the shard's texts."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.matrix) or not len(h):
            return none
        k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[k] == h, k + 2, 0)
        # stretches of known words inside one text
        row = row_of(at)
        known = symbol > 0
        start = known & np.concatenate([[True], ~known[:-1] | (row[1:] != row[:-1])])
        stretch = np.cumsum(start) - 1
        size = np.bincount(stretch[known], minlength=int(start.sum()))
        pos = np.flatnonzero(known)
        pos = pos[size[stretch[pos]] >= self.shortest]
        if not len(pos):
            return none
        s = stretch[pos]
        border = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])  # separators before each word
        text = np.ones(len(pos) + int(border[-1]) + 1, np.int64)
        where = np.arange(len(pos)) + border
        text[where], text[-1] = symbol[pos], 0
        back = np.zeros(len(text), np.int64)
        back[where] = pos
        # a window with a word that the shard lacks is not searched; 0 pads the windows and ends the text
        present = np.zeros(self.sigma, bool)
        present[text] = True
        able = np.flatnonzero(present[self.matrix].all(axis=1))
        if not len(able):
            return none
        index = FMIndex(text, self.sigma)
        lo, hi = index.search(self.matrix[able], self.lengths[able])
        some = np.flatnonzero(hi > lo)
        if not len(some):
            return none
        found, lo, count = able[some], lo[some], (hi - lo)[some]
        rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        window = np.repeat(found, count)
        first = back[index.locate(rows)]
        return window, first, first + self.lengths[window]


def _passes(docs: DataFrame, benchmark: DataFrame, item: str, text: str, search: Callable[[DataFrame, Broadcast, bool, bool], DataFrame]) -> DataFrame:
    """``search(docs, items, first, last)`` for one block of items after another. Each ends before the next one's items are read:
    a task runs one search, and one block of items is on the driver."""
    size = benchmark.select(F.sum(F.coalesce(F.length(text), F.lit(0)))).first()[0] or 0
    n = max(1, -(-int(size) // (ITEM_BLOCK * 4)))
    for q in range(n):
        part = benchmark.select(item, text)
        if n > 1:
            part = part.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == q)
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])
        docs = search(docs, held, q == 0, q == n - 1)
        if q < n - 1:
            docs = stored(docs)
            held.destroy()
    return docs


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", item: str = "item_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, n_words, spans (array of [first word, word after the last],
    merged), and items (the item ids that occur, as sorted strings)."""
    docs = docs.select(*keep, F.col(text).alias("__text"))
    answers = [("n_words", T.LongType()), ("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("items", T.ArrayType(T.StringType()))]
    schema, carried = (T.StructType([*df.schema.fields, *(T.StructField(*x) for x in answers)]) for df in (docs.drop("__text"), docs))

    def search(docs: DataFrame, held: Broadcast, first_pass: bool, last_pass: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(held.value, n)
            for b in blocks(batches, lower=True, column="__text"):
                starts, ends, at = b.runs(_WORD)
                window, first, last = windows.find(b.hashes(starts, ends), at)
                # what earlier blocks of items found comes along with the text
                spans, items = ([[] for _ in range(b.n)], [[] for _ in range(b.n)]) if first_pass else (b.column("spans"), b.column("items"))
                row = np.searchsorted(at, first, "right") - 1
                for r in np.unique(row).tolist():
                    own = row == r
                    pair = np.array([*spans[r], *np.stack([first[own], last[own]], 1) - at[r]], np.int64)
                    s, e = spans_of(covered(int(at[r + 1] - at[r]), pair[:, 0], pair[:, 1]))
                    spans[r] = np.stack([s, e], 1).tolist()
                    items[r] = sorted({*items[r], *(str(windows.ids[i]) for w in np.unique(window[own]) for i in windows.items[w])})
                names = [*keep] if last_pass else [*keep, "__text"]
                yield pa.RecordBatch.from_arrays(
                    [*(b.batch.column(c) for c in names), pa.array(np.diff(at), pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], names=[*names, *(c for c, _ in answers)]
                )

        return docs.mapInArrow(run, schema if last_pass else carried)

    return _passes(docs, benchmark, item, text, search)


def _n_hit(spans) -> F.Column:
    """Words in the spans, which lie apart."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = _n_hit(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def removed(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents with every hit word cut out (a cut leaves one space); a document of which no word
    is left goes. Columns and the other rows stay as they are. One pass a block of items, each over the whole
    texts: the words that earlier blocks hit travel along as packed pairs, and the last pass cuts."""
    mark = "__spans"
    while mark in docs.columns:
        mark += "_"
    schema = docs.schema
    carried = docs.withColumn(mark, F.lit(None).cast("binary")).schema

    def search(docs: DataFrame, held: Broadcast, first_pass: bool, last_pass: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(held.value, n)
            for b in blocks(batches, lower=True):
                starts, ends, at = b.runs(_WORD)
                _, first, last = windows.find(b.hashes(starts, ends), at)
                row = np.searchsorted(at, first, "right") - 1
                if first_pass:
                    known, out = [None] * b.n, b.batch
                else:
                    known, out = b.column(mark), b.batch.drop_columns([mark])
                for r in np.unique(row).tolist():
                    own = row == r
                    known[r] = (known[r] or b"") + (np.stack([first[own], last[own]], 1) - at[r]).astype(np.int64).tobytes()
                if last_pass:
                    yield _cut(b, out, starts, ends, at, known)
                else:
                    yield out.append_column(pa.field(mark, pa.binary()), pa.array(known, pa.binary()))

        return docs.mapInArrow(run, schema if last_pass else carried)

    return _passes(docs, benchmark, "item_id", "text", search)


def _cut(b, batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, spans: list[bytes | None]) -> pa.RecordBatch:
    """The batch without the words of its rows' spans (packed pairs of 64-bit word positions), and without rows of
    which no word is left; n_chars, where there is such a column, follows."""
    hit = [r for r, x in enumerate(spans) if x]
    if not hit:
        return batch
    texts, gone = batch.column("text").to_pylist(), set()
    sizes = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
    for r in hit:
        pair = np.frombuffer(spans[r], np.int64).reshape(-1, 2)
        mask = covered(int(at[r + 1] - at[r]), pair[:, 0], pair[:, 1])
        raw, base, parts, done = b.text_bytes(r), int(b.at[r]), [], 0
        for s, e in zip(*spans_of(mask), strict=True):
            parts.append(raw[done : int(starts[at[r] + s]) - base])
            done = int(ends[at[r] + e - 1]) - base
        parts.append(raw[done:])
        texts[r] = b" ".join(parts).decode()
        if sizes is not None:
            sizes[r] = len(texts[r])
        if mask.all():
            gone.add(r)
    for name, values in (("text", texts), ("n_chars", sizes)):
        if values is not None:
            k = batch.schema.get_field_index(name)
            batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
    return batch.take(pa.array([r for r in range(b.n) if r not in gone], pa.int64())) if gone else batch
