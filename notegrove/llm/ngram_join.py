"""N-gram Jaccard join by grouped prefix join (operator 2).

Documents link when their sets of word shingles have a Jaccard similarity of the threshold or more.

Nodes and groups. Documents with the same set are one node. Shingles have one global order: rare ones
before frequent ones (by the ``RANKS`` that their counts reach in a first round; bitmaps of fixed size
tell them apart, and a false positive only changes the order), then by hash. Two linked sets share a shingle among
the first |x| - ceil(t |x|) + 1 of each. Nodes with the same prefix and size form one group, which is
indexed once.

Group pairs. The groups of each prefix shingle are a run. A run first gives a tree (each group with TREE others below it)
and a chain of pairs, not all pairs, so that no group is in very many; these are filtered by size and by an exact bound of the overlap from
parity bitmaps (2 |x and y| <= |x| + |y| - differing bits), expanded to members and verified on the whole sets. Their
links give components. A second round takes only the runs that still hold several components, in
blocks, and compares every two nodes of different components there by size and parity; what is left is verified. So each pair that shares a prefix shingle is
either tried or inside one component already: no component is missed, and a group of thousands of near copies
costs a multiple of its size rather than the square.

Edge cases: a null text, or one without words, has an empty set and links with nothing; fewer words
than a shingle make one shingle of them all; rows without doc_id link as others do (a hash of their text stands for the
id) and have a null component only if no document that they reach has one; repeated rows each have a row; extra
columns are ignored; an empty table gives no rows. Shingles and sets are known by 64-bit hashes (a set also by its size).

Memory: hashes are dealt into buckets whose number follows the input's size, and a task holds one at a time; bitmaps
have a bit for some bytes of input, between two bounds. The groups of one prefix shingle (20 bytes each) lie in one bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrove.llm.common import Block, bitmap, bits_for, blocks, by_bucket, byte_class, dealt, documents, grams, hash_buckets, id_bit, input_bytes, inside, marked, mix, packed_ids, partitions, scatter, stored
from notegrove.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
#: Counts at which a shingle moves a rank back in the order; each rank has a bitmap, of these bits at least and at most.
RANKS = (32, 256, 2048, 16384)
RANK_BITS = (1 << 23, 1 << 27)
#: Input bytes that stand for one frequent shingle when the bitmaps are sized.
RANK_BYTES = 2048
PARITY = 1024
PARITY_MOST = 1 << 15
POOL_SHINGLES = 400_000
RUN_ROW = 4096
TREE = 16
BLOCK = 512
SEEN = 1_000_000
_U = np.uint64
_WORD = byte_class("space")


def shingle_sets(b: Block, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its set as sorted hashes) for each text with words."""
    starts, ends, at = b.runs(_WORD)
    h = b.hashes(starts, ends)
    g = grams(h, n)
    for r in range(b.n):
        i, j = at[r], at[r + 1]
        if j - i >= n:
            yield r, np.unique(g[i : j - n + 1])
        elif j > i:
            k = np.arange(1, j - i + 1).astype(_U)
            yield r, mix(np.sum(mix(h[i:j] + k), dtype=_U, keepdims=True) + k[-1:])


def signature(s: np.ndarray) -> int:
    """64-bit identity of a set and its size."""
    total = int(np.sum(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U)) + len(s) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total & 0xFFFFFFFFFFFFFFFF], _U)).view(np.int64)[0])


def parity(s: np.ndarray) -> bytes:
    """Each bit tells whether an odd number of the set's shingles fall on it; at least two bits a shingle, up to a bound."""
    size = PARITY
    while size < 2 * len(s) and size < PARITY_MOST:
        size *= 2
    return np.packbits((np.bincount(((s >> _U(7)) % _U(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap as it would be with fewer bits, as 64-bit words."""
    w = np.frombuffer(bits, _U)
    while len(w) * 64 > size:
        w = w[: len(w) // 2] ^ w[len(w) // 2 :]
    return w


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def index_size(n: int, percent: int) -> int:
    """The shorter prefix in which the smaller of two linked sets must meet the prefix of the larger."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def may_link(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """False only where sizes or parity bitmaps rule the similarity out."""
    size = 8 * min(len(x), len(y))
    apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    overlap = min((n + m - apart) // 2, n, m)
    return 100 * overlap >= percent * (n + m - overlap)


def _order_bitmap(source: DataFrame, n: int, percent: int, buckets: int, rank_bits: int) -> np.ndarray:
    """Bitmaps of the frequent shingles, one after the other, counted over distinct sets among the smallest hashes of each set,
    which are those that prefixes can hold (two fifths of a set, where a prefix is a quarter)."""

    def send(pool: dict[int, np.ndarray]) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(list(pool.values())), return_counts=True)
        rows = list(scatter(h, buckets, [h, np.minimum(count, 65_535).astype(np.uint16)]))
        return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "h": pa.array([r[1] for r in rows], pa.binary()), "c": pa.array([r[2] for r in rows], pa.binary())})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held = {}, 0
        for b in blocks(batches, lower=True):
            for _, s in shingle_sets(b, n):
                part = s[: max(1, min(len(s), prefix_size(len(s), percent) * 8 // 5))]
                pool[signature(s)] = part
                held += len(part)
            if held > POOL_SHINGLES:
                yield send(pool)
                pool, held = {}, 0
        if pool:
            yield send(pool)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_bucket(batches):
            every = [(np.frombuffer(x, _U), np.frombuffer(y, np.uint16)) for b in group for x, y in zip(b.column("h").to_pylist(), b.column("c").to_pylist(), strict=True)]
            h, count = (np.concatenate(x) for x in zip(*every, strict=True))
            order = np.argsort(h, kind="stable")
            h, count = h[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total = np.add.reduceat(count.astype(np.int64), first)
            for rank, least in enumerate(RANKS):
                bits = np.unique(h[first[total >= least]] % _U(rank_bits)).astype(np.int64) + rank * rank_bits
                for i in range(0, len(bits), 100_000):
                    yield pa.RecordBatch.from_pydict({"b": bits[i : i + 100_000]})

    sent = dealt(source.mapInArrow(emit, "bucket int, h binary, c binary"))
    return bitmap(sent.mapInArrow(often, "b long"), F.col("b"), len(RANKS) * rank_bits)


def rank_of(bitmaps: np.ndarray, s: np.ndarray) -> np.ndarray:
    """How frequent each shingle is, from 0 (rare) on; the same for the same shingle in every set."""
    size = 64 * len(bitmaps) // len(RANKS)
    bit = s % _U(size)
    out = np.zeros(len(s), np.int8)
    for rank in range(len(RANKS)):
        out += marked(bitmaps, bit + _U(rank * size))
    return out


_INDEX = "kind int, k long, r long, t long, sig long, gid long, n long, bits binary, run long, gids array<long>"
_LONGS = ("k", "r", "t", "sig", "gid", "n")
_ARROW = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in _LONGS), ("bits", pa.binary()), ("run", pa.int64()), ("gids", pa.list_(pa.int64()))])


def _index(source: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Rows of kind 0: a document (k, r, t, sig, gid, n, bits). Of kind 1: the groups of a run, ordered by size, at most
    RUN_ROW in a row. Of kind 2: some groups of each row of a long run, which tie its rows together."""
    row = RUN_ROW
    rank_bits = bits_for(input_bytes(source) // RANK_BYTES, *RANK_BITS)
    held = source.sparkSession.sparkContext.broadcast(_order_bitmap(source, n, percent, buckets, rank_bits))
    fields = ["bucket", "kind", "h", "g", "n", "r", "t", "known", "bits"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=fields)

    def send(pool: dict[int, tuple[np.ndarray, int]], docs: list[tuple]) -> pa.RecordBatch:
        rows = []
        if pool:
            gid = np.repeat(np.array(list(pool), np.int64), [len(p) for p, _ in pool.values()])
            # the size is negative where the shingle is in the shorter prefix
            size = np.concatenate([np.where(np.arange(len(p)) < index_size(m, percent), -m, m) for p, m in pool.values()]).astype(np.int32)
            h = np.concatenate([p for p, _ in pool.values()])
            rows += [(q, 1, a, b, c, None, None, None, None) for q, a, b, c in scatter(h, buckets, [h, gid, size])]
        r, t, known, sig, gid, size, bits = zip(*docs, strict=True)
        rows.append((abs(sig[0]) % buckets, 0, *(np.array(x, np.int64).tobytes() for x in (sig, gid, size, r, t)), np.array(known, bool).tobytes(), pickle.dumps(bits)))
        return batch(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, docs, held_n = {}, [], 0
        for b in blocks(batches, lower=True):
            ids, marks, known, seen = b.column("r"), b.column("t"), b.column("known"), set()
            for r, s in shingle_sets(b, n):
                m = len(s)
                p = s[np.argsort(rank_of(held.value, s), kind="stable")][: prefix_size(m, percent)]
                gid = signature(np.append(p, _U(m)))
                if gid not in pool:
                    pool[gid] = (p, m)
                    held_n += len(p)
                docs.append((ids[r], marks[r], known[r], signature(s), gid, m, parity(s)))
                seen.add(r)
            for r in set(range(b.n)) - seen:
                docs.append((ids[r], marks[r], known[r], 0, 0, 0, bytes(PARITY // 8)))
            if held_n > POOL_SHINGLES or len(docs) > 5000:
                yield send(pool, docs)
                pool, docs, held_n = {}, [], 0
        if docs:
            yield send(pool, docs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for group in by_bucket(batches):
            pool = []
            for b in group:
                for kind, h, g, m, r, t, known, bits in zip(*(b.column(c).to_pylist() for c in fields[1:]), strict=True):
                    if kind:
                        pool.append((np.frombuffer(h, _U), np.frombuffer(g, np.int64), np.frombuffer(m, np.int32)))
                    else:
                        yield _documents(r, t, known, h, g, m, pickle.loads(bits))
            if len(seen) > SEEN:  # runs are made distinct again when they are used
                seen.clear()
            if pool:
                yield from _grouped(pool, seen, percent, row)

    schema = "bucket int, kind int, h binary, g binary, n binary, r binary, t binary, known binary, bits binary"
    return dealt(source.mapInArrow(emit, schema)).mapInArrow(meet, _INDEX)


def _documents(r: bytes, t: bytes, known: bytes, sig: bytes, gid: bytes, n: bytes, bits: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(r, np.int64)
    size = len(ids)
    longs = (pa.array(ids, mask=~np.frombuffer(known, bool)), pa.array(ids), *(pa.array(np.frombuffer(x, np.int64)) for x in (t, sig, gid, n)))
    return pa.RecordBatch.from_arrays([pa.array([0] * size, pa.int32()), *longs, pa.array(bits, pa.binary()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.list_(pa.int64()))], schema=_ARROW)


def _grouped(pool: list[tuple], seen: set[int], percent: int, row: int) -> Iterator[pa.RecordBatch]:
    """The runs of a bucket that ``seen`` does not have yet, in rows of so many groups."""
    h, g, m = (np.concatenate(x) for x in zip(*pool, strict=True))
    pool.clear()
    order = np.argsort(h, kind="stable")
    h, g, m = h[order], g[order], m[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    out: list[tuple] = []
    for i in np.flatnonzero(np.diff(edge) > 1):
        own = slice(edge[i], edge[i + 1])
        gids, first = np.unique(g[own], return_index=True)
        if len(gids) < 2:
            continue
        gids = _partners(gids, m[own][first], percent)
        if len(gids) < 2:
            continue
        run = signature(gids.view(_U))
        if run not in seen:
            seen.add(run)
            # rows of a long run overlap by one, so that its chain stays whole
            out += [(1, run, gids[max(0, j - 1) : j + row]) for j in range(0, len(gids), row)]
            if len(gids) > row:
                out.append((2, run, gids[:: max(1, row // 8)]))
        if len(out) >= 1000:
            yield _runs(out)
            out = []
    if out:
        yield _runs(out)


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    c = len(rows)
    kind, run, gids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.nulls(c, pa.int64()) for _ in _LONGS), pa.nulls(c, pa.binary()), pa.array(run, pa.int64()), pa.array(gids, pa.list_(pa.int64()))], schema=_ARROW)


def _partners(gids: np.ndarray, signed: np.ndarray, percent: int) -> np.ndarray:
    """The groups of a run by size, without those that no other of the run can link with: sizes must fit, and the
    smaller of two must have the shingle in its shorter prefix."""
    size = np.abs(signed).astype(np.int64)
    order = np.lexsort((gids, size))
    gids, size, short = gids[order], size[order], signed[order] < 0
    fits = np.zeros(len(gids), bool)
    fits[:-1] = short[:-1] & (100 * size[:-1] >= percent * size[1:])
    last = np.maximum.accumulate(np.where(short, np.arange(len(gids)), -1))[:-1]
    fits[1:] |= (last >= 0) & (100 * size[np.maximum(last, 0)] >= percent * size[1:])
    return gids[fits]


def _filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that size and parity do not rule out, with the documents that stand for them."""
    side = lambda x: nodes.select(F.col("sig").alias(x), F.col("doc").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * percent))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = [may_link(*x, percent) for x in zip(*(b.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True)]
                yield b.select(["a", "b", "doc_a", "doc_b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(keep, "a long, b long, doc_a long, doc_b long")


def _verified(pairs: DataFrame, source: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity. Texts travel, not sets, which are larger; only those
    of documents that stand for a node of some pair."""
    pairs = stored(pairs)
    ends, bits = packed_ids(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")), "doc")
    held = source.sparkSession.sparkContext.broadcast(ends)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()  # a task sends rows of equal id and text once
        for batch in batches:
            ids = batch.column("r").to_numpy()
            ok = marked(held.value, id_bit(ids, bits))
            for i in np.flatnonzero(ok).tolist():
                key = (int(ids[i]), hash(batch.column("text")[i].as_py()))
                ok[i] = key not in sent
                sent.add(key)
            if ok.any():
                yield batch.filter(pa.array(ok))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def sets(batch: pa.RecordBatch, sig: str, text: str) -> list[np.ndarray | None]:
            """The sets of a column of texts, each made once while it is remembered; None for a row with
            another text of the same doc_id."""
            sigs = batch.column(sig).to_pylist()
            if len(known) > 4000:
                known.clear()
            # one text a signature; where it was another text of the same doc_id, all texts that came with it
            for firsts in (True, False):
                todo = {x: i for i, x in enumerate(sigs) if x not in known}
                rows = list(todo.values()) if firsts else [i for i, x in enumerate(sigs) if x in todo]
                if not rows:
                    break
                part = pa.RecordBatch.from_pydict({"text": batch.column(text).take(pa.array(rows))})
                for b in blocks(iter([part]), lower=True):
                    for _, s in shingle_sets(b, n):
                        known[signature(s)] = s
            return [known.get(x) for x in sigs]

        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                ok = []
                for x, y in zip(sets(batch, "a", "s"), sets(batch, "b", "t"), strict=True):
                    both = np.sort(np.concatenate([x, y])) if x is not None and y is not None else None
                    o = 0 if both is None else int(np.count_nonzero(both[1:] == both[:-1]))
                    ok.append(both is not None and 100 * o >= percent * (len(both) - o))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    texts = source.mapInArrow(wanted, source.schema)
    both = pairs.join(texts.select(F.col("r").alias("doc_a"), F.col("text").alias("s")), "doc_a").join(texts.select(F.col("r").alias("doc_b"), F.col("text").alias("t")), "doc_b")
    return both.select("a", "b", "s", "t").mapInArrow(check, "a long, b long")


def _across(spread: DataFrame, nodes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Pairs (a, b, doc_a, doc_b) of nodes of different components that share a run and that size and parity
    do not rule out. spread: (run, sig, n, component). A long run is cut into blocks of BLOCK members and each pair of
    blocks compared on its own; a pair is given by the first run that its two nodes share, so once."""
    size = spread.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    size = size.select("run", F.ceil(F.col("c") / BLOCK).cast("int").alias("cells"))
    left = spread.join(size, "run")
    lists = left.groupBy("sig").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    rows = left.join(nodes.select("sig", "doc", "bits").join(lists, "sig"), "sig")
    own = F.pmod(F.xxhash64("sig"), F.col("cells")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = rows.select("run", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "sig", "doc", "n", "component", "bits", "runs")
    dealt = rows.repartition(buckets, "run", "x", "y").sortWithinPartitions("run", "x", "y")

    def compare(key: tuple, part: pa.Table) -> pa.RecordBatch | None:
        n, comp, own, sig, doc = (part.column(c).to_numpy() for c in ("n", "component", "own", "sig", "doc"))
        if len(n) < 2 or comp.min() == comp.max():
            return None
        whole = part.column("bits").to_pylist()
        bits = np.stack([folded(w, PARITY) for w in whole])
        lists = part.column("runs").to_pylist()
        run, x, y = key
        out = []
        for i in range(0, len(n), 64):
            k = slice(i, i + 64)
            apart = np.bitwise_count(bits[k, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int64)
            total = n[k, None] + n[None, :]
            overlap = np.minimum((total - apart) // 2, np.minimum(n[k, None], n[None, :]))
            ok = (100 * overlap >= percent * (total - overlap)) & (comp[k, None] != comp[None, :]) & (sig[k, None] < sig[None, :])
            if x != y:
                ok &= own[k, None] != own[None, :]
            for p, q in zip(*np.nonzero(ok), strict=True):
                p += i
                if min(set(lists[p]) & set(lists[q])) == run and may_link(int(n[p]), int(n[q]), whole[p], whole[q], percent):
                    out.append((p, q))
        if not out:
            return None
        p, q = np.array(out).T
        return pa.RecordBatch.from_pydict({"a": sig[p], "b": sig[q], "doc_a": doc[p], "doc_b": doc[q]})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None else now
            keys = np.stack([now.column(c).to_numpy().astype(np.int64) for c in ("run", "x", "y")], 1)
            edge = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for i, j in zip(np.concatenate([[0], edge[:-1]]) if len(edge) else [], edge, strict=True):
                got = compare(tuple(keys[i].tolist()), now.slice(i, j - i))
                if got is not None:
                    yield got
            rest = now.slice(int(edge[-1]) if len(edge) else 0)
        if rest is not None and rest.num_rows:
            key = tuple(int(rest.column(c)[0].as_py()) for c in ("run", "x", "y"))
            got = compare(key, rest)
            if got is not None:
                yield got

    return dealt.mapInArrow(stream, "a long, b long, doc_a long, doc_b long")


def _tree(runs: DataFrame) -> DataFrame:
    """Pairs of groups of each run: each with the TREE after it in breadth-first order, and neighbours by size."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gids in b.column("gids").to_pylist():
                g = np.array(gids, np.int64)
                x = np.concatenate([g[np.arange(len(g) - 1) // TREE], g[1:-1]])
                y = np.concatenate([g[1:], g[2:]])
                yield pa.RecordBatch.from_pydict({"ga": np.minimum(x, y), "gb": np.maximum(x, y)})

    return runs.select("gids").mapInArrow(emit, "ga long, gb long").where("ga <> gb").distinct()


def row_key(text: str = "text", key: str = "doc_id") -> tuple[Column, Column]:
    """(r, t) of a row: its id, or a hash of the text where it has none; and a hash of the text."""
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(text)), F.xxhash64(text)


def linked_rows(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, r, t, n, component, component_id) of every row: its id, ``row_key``, the size of its set, a label of its component
    (null for an empty set) and the smallest id in that."""
    spark = docs.sparkSession
    r, t = row_key(text, key)
    source = docs.select(r.alias("r"), t.alias("t"), F.col(key).isNotNull().alias("known"), F.col(text).alias("text"))
    index = stored(_index(source, n, percent, hash_buckets(source)))
    members = index.where("kind = 0").select("k", "r", "t", "sig", "gid", "n", "bits")
    nodes = stored(members.where("n > 0").groupBy("sig").agg(F.min("k").alias("least"), F.min("r").alias("doc"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("bits").alias("bits")))
    runs = index.where("kind = 1").select("run", "gids")
    reps = nodes.groupBy("gid").agg(F.min("sig").alias("rep"))
    pairs = _tree(index.where("kind > 0"))
    across = pairs.join(reps.select(F.col("gid").alias("ga"), F.col("rep").alias("a")), "ga").join(reps.select(F.col("gid").alias("gb"), F.col("rep").alias("b")), "gb").select("a", "b")
    within = nodes.join(reps, "gid").where("sig <> rep").select(F.col("rep").alias("a"), F.col("sig").alias("b"))
    tried = stored(across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = stored(_verified(_filtered(tried, nodes, percent), source, n, percent))
    found = connected_components(links)

    # the runs, and groups, that still hold several components
    label = nodes.select("sig", "gid", "n").join(found.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    spread = runs.select("run", F.explode("gids").alias("gid")).distinct().join(label, "gid").select("run", "sig", "n", "component")
    spread = stored(spread.unionByName(label.select(F.col("gid").alias("run"), "sig", "n", "component")))
    more = stored(_verified(_across(spread, nodes, percent, partitions(spark)), source, n, percent))
    if more.limit(1).count():
        found = connected_components(links.unionByName(more))
    by = nodes.select("sig", "least").join(found.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    first = by.groupBy("component").agg(F.min("least").alias("component_id"))
    of = by.join(first, "component").select("sig", "component", "component_id")
    linked = members.where("n > 0").select("k", "r", "t", "sig", "n").join(of, "sig").drop("sig")
    alone = members.where("n = 0").select("k", "r", "t", "n", F.lit(None).cast("long").alias("component"), F.col("k").alias("component_id"))
    return linked.unionByName(alone)


def ngram_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_shingles and component_id (the smallest doc_id reachable) of every row."""
    return linked_rows(docs, n, percent, text, key).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows without near copies: of each component the row of the smallest id stays (rows without one come last; ties by
    the hash of the text), of rows equal in id and text one, and every row without words. Only rows that may go are
    shuffled: a bitmap tells them."""
    spark = docs.sparkSession
    found = stored(linked_rows(docs, n, percent, text, key).where("component is not null").groupBy("component", "r", "t").agg(F.min("k").alias("k"), F.count("*").alias("c")))
    order = F.struct(F.col("k").isNull(), "k", "r", "t")
    lead = found.groupBy("component").agg(F.min(order).alias("o")).select("component", F.col("o.r").alias("lr"), F.col("o.t").alias("lt"))
    act = found.join(lead, "component").withColumn("gone", (F.col("r") != F.col("lr")) | (F.col("t") != F.col("lt")))
    act = stored(act.where("gone or c > 1").select("r", "t", "gone", F.xxhash64("r", "t").alias("both")))
    ids, bits = packed_ids(act, "both")
    held = spark.sparkContext.broadcast(ids)
    r, t = row_key(text, key)
    rows = docs.select(F.struct("*").alias("row"), r.alias("r"), t.alias("t")).withColumn("both", F.xxhash64("r", "t"))

    def part(maybe: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(marked(held.value, id_bit(b.column("both").to_numpy(), bits)) == maybe))

        return rows.mapInArrow(run, rows.schema)

    met = part(True).join(act.select("r", "t", "gone"), ["r", "t"], "left")
    single = met.where("gone is null").select("row")
    # rows equal in id and text: aggregated before they are shuffled, so however many they are
    again = met.where("not gone").groupBy("r", "t").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return part(False).select("row").unionByName(single).unionByName(again).select("row.*")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))
