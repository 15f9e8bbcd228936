"""WARC with a Merkle fixity audit (operator 7).

Pages are laid out as response records in segments of an archive; a record's place is its page_id's slot in the
segment, page_id mod ``SEGMENT``, plus ``SEGMENT`` for each other record of that page_id before it, so that a lost or added
record moves no record of another page. Records lie in order of place. Each record is hashed; the offset ranges of every ``FAN``
consecutive places of a segment are hashed, with their places, into a parent range, up to the segment's root, and
segments' roots, by segment number, into the archive's root in the same way. To compare two replicas, only the archives' roots are
compared first; a level below is read only under branches that differ, down to the records: an intact branch is never descended.

Equal records are counted before anything else and are one leaf, whose digest covers their number, so a page in a third of
all rows is one row. Trees are built one segment to a task (at most ``SEGMENT`` page ids and their different contents), so no step
holds more than one segment; upper levels are ordinary aggregations of ordered digests. Records are hashed in the JVM where they
are read, so texts are never shuffled. Nodes are stored a folder a level.

Edge cases: a null html is an empty payload and a null url an empty one; rows without page_id lie in
segments of their own, ``LOOSE`` by the hash of their content, numbered below all others, with slots by that hash too; repeated pages are records of their own,
told apart by their content where one replica lacks some; a record that only one
replica has is missing there; extra columns are ignored; empty archives are equal.
"""

from __future__ import annotations

import gzip
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrove.llm.common import small_batches, stored

SEGMENT = 256
FAN = 16
LOOSE = 1 << 16
_CRLF = b"\r\n"


def _layout(number, url, length, payload) -> list:
    """The parts of one WARC/1.0 response record, as text; the same for a record that is written and one that is hashed in place."""
    return ["WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:", number, ">\r\nWARC-Target-URI: ", url, "\r\nContent-Type: text/html\r\nContent-Length: ", length, "\r\n\r\n", payload, "\r\n\r\n"]


def record(url: str | None, payload: bytes, number: int) -> bytes:
    """One WARC/1.0 response record."""
    return b"".join(x if isinstance(x, bytes) else x.encode() for x in _layout(str(number), url or "", str(len(payload)), payload))


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, payload, first byte, byte after the last) of each record of a segment."""
    at = 0
    while at < len(data):
        end = data.index(_CRLF * 2, at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        stop = end + 4 + size
        yield head, data[end + 4 : stop], at, stop + 4
        at = stop + 4


def segment_bytes(pages: Iterable[tuple[int, str | None, str | None]], compress: bool = False) -> bytes:
    """A whole segment; compressed, each record is a member of its own, so that offsets stay seekable."""
    parts = (record(u, (h or "").encode(), -1 if i is None else i) for i, u, h in pages)
    return b"".join(gzip.compress(p, mtime=0) if compress else p for p in parts)


def _digest(*parts: bytes) -> str:
    return hashlib.sha256(b"".join(parts)).hexdigest()


_NODES = "segment long, level int, place long, first_byte long, end_byte long, digest string, page_id long, n_bytes long, payload_sha256 string, record string, copies long"


def nodes(pages: DataFrame) -> DataFrame:
    """The tree of every segment: level 0 are its records (``copies`` equal ones each, with the digest of one as ``record``), each
    level above has a node for FAN ranges; the single node of the highest level is the root."""
    url, html, page = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")), F.col("page_id").cast("long")
    raw = F.concat(*(x if isinstance(x, F.Column) else F.lit(x) for x in _layout(F.coalesce(page, F.lit(-1)).cast("string"), url, F.octet_length(html).cast("string"), html)))
    loose = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("url", "html"), F.lit(LOOSE))
    slot = F.pmod(F.coalesce(page, F.shiftright(F.xxhash64("url", "html"), 32)), F.lit(SEGMENT)).cast("long")
    # hashed where it is read: from here on a record is some 200 bytes, whatever its length
    of = pages.select(F.coalesce(F.shiftright(page, SEGMENT.bit_length() - 1), loose).alias("segment"), slot.alias("slot"), page.alias("page_id"), F.sha2(raw, 256).alias("record"), F.octet_length(raw).cast("long").alias("size"), F.octet_length(html).cast("long").alias("n_bytes"), F.sha2(html, 256).alias("payload_sha256"))
    of = of.groupBy("segment", "slot", "page_id", "record", "size", "n_bytes", "payload_sha256").agg(F.count("*").alias("copies"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seg = int(pdf["segment"].iloc[0])
        ids = [None] * len(pdf) if pdf["page_id"].isna().all() else pdf["page_id"].astype("int64").tolist()  # a segment has ids or none
        rows = sorted(zip(*(pdf[c].tolist() for c in ("slot", "record", "size", "n_bytes", "payload_sha256", "copies")), ids, strict=True), key=lambda r: r[:2])
        before: Counter = Counter()
        placed = []
        for slot, *rest in rows:
            placed.append((slot + SEGMENT * before[slot], *rest))
            before[slot] += 1
        out, at = [], 0
        for k, one, size, n, sha, c, i in sorted(placed, key=lambda r: r[0]):
            out.append((seg, 0, k, at, at + c * size, one if c == 1 else _digest(b"%d*" % c + bytes.fromhex(one)), i, n, sha, one, c))
            at += c * size
        level = out
        depth = 0
        while level[-1][2] > 0:
            depth += 1
            level = [(seg, depth, k, x[0][3], x[-1][4], _digest(*(b"%d:" % c[2] + bytes.fromhex(c[5]) for c in x)), None, None, None, None, None) for k, x in ((k, list(g)) for k, g in groupby(level, lambda c: c[2] // FAN))]
            out += level
        got = pd.DataFrame(out, columns=["segment", "level", "place", "first_byte", "end_byte", "digest", "page_id", "n_bytes", "payload_sha256", "record", "copies"], dtype=object)  # ids beyond 2^53 stay exact beside nulls
        return got.astype({"segment": "int64", "level": "int32", "place": "int64", "first_byte": "int64", "end_byte": "int64", "page_id": "Int64", "n_bytes": "Int64", "copies": "Int64"})

    return of.groupBy("segment").applyInPandas(build, _NODES)


def roots(tree: DataFrame) -> DataFrame:
    """(loose, number, segment, level, digest): the root of each segment, under which branch and number the archive's tree has it."""
    top = tree.groupBy("segment").agg(F.max_by("digest", "level").alias("digest"), F.max("level").alias("level"))
    loose = F.col("segment") < -(1 << 61)
    return top.select(loose.alias("loose"), F.when(loose, F.col("segment") + F.lit(1 << 62)).otherwise(F.col("segment")).alias("number"), "segment", "level", "digest")


def _hashed(nodes_: DataFrame, keys: list[str]) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("loose", "number", "digest")))
    text = F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["loose"].cast("string"), x["number"].cast("string"), x["digest"])), ",")
    return (nodes_.groupBy(*keys) if keys else nodes_).agg(F.sha2(text, 256).alias("digest"))


def archive(tops: DataFrame, depth: int) -> tuple[list[DataFrame], str]:
    """The levels (loose, number, digest) over segments' roots, FAN numbers to a node, and the archive's root."""
    levels = [tops.select("loose", "number", "digest")]
    for _ in range(depth):
        levels.append(stored(_hashed(levels[-1].withColumn("up", F.shiftright("number", FAN.bit_length() - 1)), ["loose", "up"]).withColumnRenamed("up", "number")))
    return levels, _hashed(levels[-1], []).first()["digest"]


def _depth(*tops: DataFrame) -> int:
    """So many levels until each branch has one node, or two where numbers are negative too."""
    ends = [v for t in tops for v in t.agg(F.min("number"), F.max("number")).first() if v is not None]
    depth = 0
    while any(v >> (depth * (FAN.bit_length() - 1)) not in (0, -1) for v in ends):
        depth += 1
    return depth


def _differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(loose, number) of the segments whose roots differ, by descent from the archives' highest level."""
    on = ["loose", "number"]
    under = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if under is not None:
            up = under.withColumnRenamed("number", "up")
            x, y = (t.withColumn("up", F.shiftright("number", FAN.bit_length() - 1)).join(up, ["loose", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.join(y.withColumnRenamed("digest", "other"), on, "full_outer")
        under = stored(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select(*on))
    return under


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(segment, place, page_id, damage) of the records that differ between two trees of ``nodes``.
    damage: ``changed``, ``missing`` (the replica lacks it) or ``extra``."""
    a, b = stored(roots(primary)), stored(roots(replica))
    depth = _depth(a, b)
    (ups, root), (others, other) = archive(a, depth), archive(b, depth)
    if root == other:
        return primary.select("segment", "place", "page_id", F.lit("changed").alias("damage")).limit(0)
    under = _differing(ups, others)
    both = a.join(under, ["loose", "number"], "left_semi").unionByName(b.join(under, ["loose", "number"], "left_semi"))
    differ = stored(both.groupBy("segment").agg(F.max("level").alias("level")).withColumn("place", F.lit(0).cast("long")))
    deepest = differ.agg(F.max("level")).first()[0]
    pick = lambda t, level, name: t.where(F.col("level") == level).select("segment", "level", "place", F.col("digest").alias(name), F.col("page_id").alias(f"{name}_page"))
    for level in range(deepest or 0, 0, -1):
        here = differ.where(F.col("level") == level)
        below = here.select("segment", F.lit(level - 1).alias("level"), F.explode(F.expr(f"sequence(place * {FAN}, place * {FAN} + {FAN - 1})")).alias("place"))
        x = below.join(pick(primary, level - 1, "a"), ["segment", "level", "place"], "left").join(pick(replica, level - 1, "b"), ["segment", "level", "place"], "left")
        open_ = x.where(~F.col("a").eqNullSafe(F.col("b"))).select("segment", "level", "place")
        differ = stored(differ.where(F.col("level") < level).unionByName(open_))
    # a root that is a record itself may have any place; of repeated pages those that both replicas hold are intact
    held = [_numbered(t.where("level = 0").join(differ.where("level = 0").select("segment", "place"), ["segment", "place"], "left_semi")) for t in (primary, replica)]
    same = ["segment", "slot", "digest", "nth"]
    left, right = (_ranked(x.join(y.select(*same), same, "left_anti"), sign) for x, y, sign in ((*held, 1), (*held[::-1], -1)))
    found = left.join(right.select("segment", "slot", "r", F.col("place").alias("b_place"), F.col("page_id").alias("b_page")), ["segment", "slot", "r"], "full_outer")
    damage = F.when(F.col("b_place").isNull(), "missing").when(F.col("place").isNull(), "extra").otherwise("changed")
    return found.select("segment", F.coalesce("place", "b_place").alias("place"), F.coalesce("page_id", "b_page").alias("page_id"), damage.alias("damage"))


def _numbered(leaves: DataFrame) -> DataFrame:
    """Records with their slot and their number among equal ones of it."""
    x = leaves.select("segment", (F.col("place") % SEGMENT).alias("slot"), "place", F.col("record").alias("digest"), "page_id", "copies")
    return x.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def _ranked(leaves: DataFrame, sign: int) -> DataFrame:
    """Records in the order in which those of one page are compared; ones without page_id are no one's counterpart."""
    r = F.row_number().over(Window.partitionBy("segment", "slot").orderBy("place", "nth"))
    return leaves.withColumn("r", F.when(F.col("page_id").isNull(), r * sign).otherwise(r))


def op7_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Audits the archive of ``pages`` against a replica in which every 97th page (page_id mod 97 = 5) has its
    first character overwritten (an empty one gets one): each page with its record's segment, payload size and digest, and whether the audit
    finds it corrupt."""
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hurt = pages.withColumn("html", F.when(F.col("page_id") % 97 == 5, F.overlay(F.coalesce("html", F.lit("")), F.when(F.col("html").startswith("~"), "!").otherwise("~"), F.lit(1))).otherwise(F.col("html")))
    a, b = stored(nodes(pages), "level"), stored(nodes(hurt), "level")
    found = audit(a, b).select("segment", "place", F.lit(True).alias("corrupt")).distinct()
    out = a.where("level = 0").join(found, ["segment", "place"], "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))  # a row for each page again
    return out.select("page_id", "segment", "n_bytes", "payload_sha256", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))
