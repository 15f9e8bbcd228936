"""Conversation prefix trie (operator 13).

Conversations are rebuilt (each takes its first turns from the conversation that opens its group), and every distinct sequence of
first turns is a node. A node is known by its depth and by two polynomials over 64-bit hashes of its turns, 128 bits in all, which
a prefix scan gives: rows are dealt by ranges of (conversation, turn), each task scans its own, and what the last
conversation of a task brings into the next one, a row a task, is added afterwards. So one conversation with very many turns is
spread over tasks, and a node's key costs no look at the turns before it. What two different sequences share a key is
their chance of 2^-128 a pair.

Sums over subtrees use heavy paths. The heavy child of a node is the one with the most members, so an edge to another child
halves the members at least, and no node has more than log2(conversations) of such light edges above it. A path runs from the
root or a light child down to a leaf and is named by the leaf's smallest member, on whose own turns all its nodes lie: the top
is below that conversation's last light edge, found by one aggregation. Paths are attached to the nodes that they hang from, those with
most light edges above them first, a round for each number of light edges; then one scan along the arrays of paths, from
the leaf up, turns values into sums over subtrees.

Digests of members need them in order: ranges of sorted ids are written into texts of at most ``ENDS_CHARS`` in parallel, and a
node's texts are then hashed one after another, so that a task holds one text whatever the number of members.

Edge cases: rows without conv_id belong to no conversation and are left out; a null turn comes first; a null role or text is
empty; rows of one turn number are ordered by role and text, and repeated rows are turns of their own; ``%`` keeps the sign of
its left side, so conversations -19 to 19 take their first turns from 0; extra columns are ignored; an empty table gives no rows, as the root
has no member then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrove.llm.common import partitions, stored

GROUP, MOST_HEAD = 20, 3
ENDS_CHARS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64
#: Odd, so it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
KEY = ["depth", "k1", "k2"]


def power(exponents: np.ndarray) -> np.ndarray:
    """_BASE to each exponent, modulo 2^64; exponents may be negative."""
    e = np.abs(exponents).astype(_U)
    out = np.ones(len(e), _U)
    base = np.where(exponents < 0, _U(_INVERSE), _U(_BASE))
    while e.any():
        out = np.where(e & _U(1), out * base, out)
        base = base * base
        e >>= _U(1)
    return out


def _u(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def scanned(df: DataFrame, group: str, order: list[Column], ranges: list[Column], sums: tuple[str, ...] = (), terms: tuple[str, ...] = ()) -> DataFrame:
    """df with ``place`` (from 1 within the group, in the given order) and running values within the group: for each of ``sums``
    the sum so far, for each of ``terms`` its polynomial so far (same names) and the one before the row (name_before).
    Rows are dealt by ``ranges``, which must order groups as ``group`` does and rows as ``order``; only the columns that they
    and the rows' own order leave apart are sorted in a task. A group may span any number of tasks."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in (*sums, *terms)]
    dealt = df.repartitionByRange(partitions(spark), *ranges).sortWithinPartitions(*order)
    # what only the order needs is not passed on
    names = [c for c in rest if not c.startswith("order_")]
    schema = T.StructType([T.StructField("part", T.IntegerType()), *(df.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in ("place", *sums, *terms, *(f"{t}_own" for t in terms)))])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, place = None, 0
        held = [np.zeros(1, _U) for _ in (*sums, *terms)]
        for b in batches:
            n = len(b)
            if not n:
                continue
            key = b.column(group).to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], key[1:] != key[:-1]])
            begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            goes_on = (begin == 0) & (last is not None and key[0] == last)
            at = np.arange(n) - begin + 1 + np.where(goes_on, place, 0)
            weight = power(at) if terms else None
            running = []
            for j, c in enumerate((*sums, *terms)):
                v = _u(b.column(c)) * weight if c in terms else _u(b.column(c))
                total = np.concatenate([[_U(0)], np.cumsum(v, dtype=_U)])
                running.append(total[1:] - total[begin] + np.where(goes_on, held[j][0], _U(0)))
            last, place, held = key[-1], int(at[-1]), [r[-1:].copy() for r in running]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), *(b.column(c) for c in names), pa.array(at), *map(_long, running), *(b.column(c) for c in terms)],
                names=["part", *names, "place", *sums, *terms, *(f"{t}_own" for t in terms)],
            )

    own = stored(dealt.mapInArrow(local, schema))
    # groups ascend within a task, and places within a group
    ends = own.groupBy("part").agg(F.min(group).alias("first"), F.max(F.struct(group, "place", *sums, *terms)).alias("last"))
    carried = _carries(ends.orderBy("part").collect(), group, sums, terms)  # a row a task
    out = T.StructType([*(df.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in ("place", *sums, *terms, *(f"{t}_before" for t in terms)))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, key = b.column("part").to_numpy(), b.column(group).to_numpy(zero_copy_only=False)
            on = carried["known"][part] & (carried["group"][part] == key)
            off = np.where(on, carried["place"][part], 0)
            at = b.column("place").to_numpy() + off
            made = [_long(_u(b.column(c)) + np.where(on, carried[c][part], _U(0))) for c in sums]
            before = []
            if terms:
                lift, weight = power(off), power(at)
                for t in terms:
                    s = _u(b.column(t)) * lift + np.where(on, carried[t][part], _U(0))
                    made.append(_long(s))
                    before.append(_long(s - _u(b.column(f"{t}_own")) * weight))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(at), *made, *before], names=out.names)

    return own.mapInArrow(whole, out)


def _carries(ends: list, group: str, sums: tuple[str, ...], terms: tuple[str, ...]) -> dict[str, np.ndarray]:
    """What each task's first group brings from the tasks before, by task."""
    n = max((r["part"] for r in ends), default=-1) + 1
    out = {"known": np.zeros(n, bool), "group": np.zeros(n, np.int64), "place": np.zeros(n, np.int64)} | {c: np.zeros(n, _U) for c in (*sums, *terms)}
    run: dict | None = None
    for r in ends:
        last = {"group": r["last"][group], "place": r["last"]["place"]} | {c: r["last"][c] % (1 << 64) for c in (*sums, *terms)}
        if run is not None and run["group"] == r["first"]:
            p = r["part"]
            out["known"][p], out["group"][p], out["place"][p] = True, run["group"], run["place"]
            for c in (*sums, *terms):
                out[c][p] = run[c]
            if last["group"] == run["group"]:
                lift = pow(_BASE, run["place"], 1 << 64)
                last |= {c: (run[c] + last[c]) % (1 << 64) for c in sums} | {c: (run[c] + lift * last[c]) % (1 << 64) for c in terms}
                last["place"] += run["place"]
        run = last
    return out


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place, k1, k2 (key of the turns so far), k1_before, k2_before and words of every original turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("order_turn"), role.alias("order_role"), text.alias("order_text"), F.xxhash64(F.lit(1), role, text).alias("k1"),
        F.xxhash64(F.lit(2), role, text).alias("k2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    turn = F.col("order_turn").asc_nulls_first()
    # bounds of ranges reach the driver, so they hold the beginnings of texts only, which order rows as whole texts do
    ranges = [F.col("conv_id").asc(), turn, F.substring("order_role", 1, 16).asc(), F.substring("order_text", 1, 32).asc()]
    return scanned(turns, "conv_id", [F.col("conv_id"), turn, F.col("order_role"), F.col("order_text")], ranges, terms=("k1", "k2"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, last): each conversation's nodes below the root with the keys of their parents, and
    a row of depth 0 for the root; last marks its own end."""
    first = {i: F.max(F.when(F.col("place") == i, F.struct("k1", "k2", "words"))).alias(f"t{i}") for i in range(1, MOST_HEAD + 1)}
    convs = stored(turns.groupBy("conv_id").agg(F.max("place").alias("n"), *first.values()))
    base = convs.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *(F.col(f"t{i}").alias(f"b{i}") for i in first))
    own = convs.withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1))
    both = own.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    none = F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("words"))
    pick = lambda kind, at: F.element_at(F.array(none, *(F.coalesce(f"{kind}{i}", none) for i in first)), (at + 1).cast("int"))
    plan = both.select(
        "conv_id", "h", "m", (F.col("m") - F.col("h")).alias("shift"), (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
        pick("b", F.col("m")).alias("head"), pick("t", F.least("h", "n")).alias("cut"), F.slice(F.array(*(f"b{i}" for i in first)), F.lit(1), F.col("m").cast("int")).alias("heads"),
    )
    plan = stored(plan)
    edge = plan.select("conv_id", "h", "shift", "total", F.col("head.k1").alias("h1"), F.col("head.k2").alias("h2"), F.col("cut.k1").alias("c1"), F.col("cut.k2").alias("c2"))
    joined = turns.join(edge, "conv_id").where("place > h")
    schema = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, last boolean"

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A key is the head's with what the turns after the cut add, moved to their new places."""
        for b in batches:
            shift, place = b.column("shift").to_numpy(), b.column("place").to_numpy()
            lift, depth = power(shift), place + shift
            key = lambda h, c, k: _long(_u(b.column(h)) + (_u(b.column(k)) - _u(b.column(c))) * lift)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array(depth), key("h1", "c1", "k1"), key("h2", "c2", "k2"), key("h1", "c1", "k1_before"), key("h2", "c2", "k2_before"), b.column("words"), pa.array(depth == b.column("total").to_numpy())],
                names=["conv_id", "depth", "k1", "k2", "p1", "p2", "words", "last"],
            )

    tail = joined.mapInArrow(moved, schema)
    zero = F.lit(0).cast("long")
    at = plan.select("conv_id", "total", "heads", F.posexplode("heads").alias("i", "t"))
    parent = lambda k: F.when(F.col("i") == 0, zero).otherwise(F.element_at("heads", F.greatest(F.col("i"), F.lit(1)))[k])
    heads = at.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t.k1", "t.k2", parent("k1").alias("p1"), parent("k2").alias("p2"), "t.words", (F.col("i") + 1 == F.col("total")).alias("last"))
    root = plan.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"), (F.col("total") == 0).alias("last"))
    return tail.unionByName(heads).unionByName(root)


def digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which some conversations end. ends: (depth, k1, k2, conv_id)."""
    n = partitions(ends.sparkSession)

    def grouped(b: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        keys = np.stack([b.column(c).to_numpy() for c in KEY])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        edges = [0, *cuts.tolist(), keys.shape[1]]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield tuple(keys[:, i].tolist()), i, j

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sorted ids of a node in a batch, in texts of at most ENDS_CHARS."""
        for b in batches:
            ids = b.column("conv_id").to_pylist()
            rows = []
            for key, i, j in grouped(b) if len(b) else ():
                for k in range(i, j, ENDS_CHARS // 20):
                    rows.append((*key, ids[k], ",".join(map(str, ids[k : min(j, k + ENDS_CHARS // 20)]))))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in range(4)), pa.array([r[4] for r in rows], pa.string())], names=[*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out, texts = [], b.column("ids").to_pylist()
            for key, i, j in grouped(b) if len(b) else ():
                if key != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                    sha.update(texts[i].encode())
                    i += 1
                for t in texts[i:j]:
                    sha.update(b"," + t.encode())
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in out], pa.int64()) for c in range(3)), pa.array([r[3] for r in out], pa.string())], names=[*KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([sha.hexdigest()])], names=[*KEY, "ends_sha256"])

    pieces = ends.select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = pieces.mapInArrow(packed, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def heavy_paths(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``nodes`` (below the root; with heavy flags and n_children) laid on heavy paths: path, top, level and the node's columns, a row
    a node. members: (conv_id, depth, k1, k2) of every conversation."""
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"))
    lines = members.where("depth > 0").select(F.col("conv_id").alias("path"), *KEY).join(leaves, "path", "left_semi")
    on_lines = stored(lines.join(nodes, KEY))
    tops = on_lines.groupBy("path").agg(F.coalesce(F.max(F.when(~F.col("heavy"), F.col("depth"))), F.lit(0)).alias("top"), F.count_if(~F.col("heavy")).alias("level"))
    return on_lines.join(tops, "path").where("depth >= top")


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    members = stored(rebuilt(numbered(conversations)))
    plain = stored(
        members.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("words").alias("words"), F.count_if("last").alias("n_ends")
        )
    )
    # of children with as many members the one with the smallest conv_id is heavy
    rank = F.struct("n_convs", F.bitwise_not("conv_id").alias("x"))
    below = plain.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), F.max(rank).alias("best"))
    nodes = stored(plain.join(below, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    root = nodes.where("depth = 0").first()
    if root is None:
        return plain.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", *(F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256"))
    # children of the root, which may be a large share of all nodes, need no join
    best = F.struct(F.lit(root["best"]["n_convs"] if root["best"] else 0).cast("long").alias("n_convs"), F.lit(root["best"]["x"] if root["best"] else 0).cast("long").alias("x"))
    flat = nodes.drop("best").withColumn("rank", rank)
    high = flat.where("depth = 1").select("*", F.lit(root["conv_id"]).cast("long").alias("parent_conv_id"), (F.col("rank") == best).alias("heavy"))
    parents = nodes.where("depth > 0 AND n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "best")
    low = flat.where("depth > 1").join(parents, ["depth", "p1", "p2"]).withColumn("heavy", F.col("rank") == F.col("best")).drop("best")
    linked = high.unionByName(low).drop("rank")
    laid = heavy_paths(linked, members).withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    laid = stored(laid.drop("words"))
    trunk = laid.where("top = 0").select("path").first()  # the one path without a light edge, the root's
    trunk = trunk["path"] if trunk else root["conv_id"]
    crown = spark.createDataFrame(
        [(trunk, 0, 0, 0, root["conv_id"], root["n_convs"], 0, 0, root["n_ends"], root["n_children"], None, True, 0, 0, int(root["n_children"] == 0), 0)],
        "path long, depth long, k1 long, k2 long, conv_id long, n_convs long, p1 long, p2 long, n_ends long, n_children long, parent_conv_id long, heavy boolean, top long, level long, leaves long, saved long",
    )
    laid = laid.unionByName(crown)
    hung = attached(laid, trunk)
    valued = laid.join(hung, ["path", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_hung", F.lit(0)) for c in ("leaves", "saved")}).drop("leaves_hung", "saved_hung")
    # from the leaf up: a running sum in the order of falling depth
    narrow = valued.select("path", "depth", "k1", "k2", "conv_id", "parent_conv_id", "n_convs", "n_children", "leaves", "saved")
    summed = scanned(narrow, "path", [F.col("path"), F.col("depth").desc()], [F.col("path").asc(), F.col("depth").desc()], sums=("leaves", "saved"))
    ends = digests(members.where("last"))
    empty = hashlib.sha256(b"").hexdigest()
    return summed.join(ends, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


def attached(laid: DataFrame, trunk: int) -> DataFrame:
    """(path, depth, leaves_hung, saved_hung): what light paths add to the nodes that they hang from. A round takes the paths
    with the same number of light edges above them; the rounds are as many as these numbers, at most log2(conversations)."""
    own = laid.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("level").alias("level"))
    tops = laid.where("depth = top AND depth > 0").select("path", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    # paths that hang from the root need no join, others find the path on which the node above them lies
    of_root = tops.where("depth = 0").select("path", "depth", F.lit(trunk).cast("long").alias("above"))
    others = tops.where("depth > 0").join(laid.select(*KEY, F.col("path").alias("above")), KEY).select("path", "depth", "above")
    paths = stored(own.join(of_root.unionByName(others), "path", "left"), by="level")
    most = paths.agg(F.max("level")).first()[0]
    up, out = None, None
    for level in range(most, 0, -1):
        now = paths.where(F.col("level") == level)
        if up is not None:
            now = now.join(up, F.col("path") == F.col("up_path"), "left").withColumns({c: F.col(c) + F.coalesce(f"up_{c}", F.lit(0)) for c in ("leaves", "saved")})
        hung = stored(now.groupBy(F.col("above").alias("path"), "depth").agg(F.sum("leaves").alias("leaves_hung"), F.sum("saved").alias("saved_hung")))
        up = hung.groupBy(F.col("path").alias("up_path")).agg(F.sum("leaves_hung").alias("up_leaves"), F.sum("saved_hung").alias("up_saved"))
        out = hung if out is None else out.unionByName(hung)
    return out if out is not None else paths.limit(0).select("path", "depth", F.col("leaves").alias("leaves_hung"), F.col("saved").alias("saved_hung"))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
