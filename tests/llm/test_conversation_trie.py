"""The trie against a plain one that holds every prefix."""

import hashlib
import random
import re
import zlib

import pytest

from notegrove.llm import conversation_trie
from notegrove.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import difference

SCHEMA = "conv_id long, turn long, role string, text string, depth int, order_x string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(int(c - (abs(c) % 20) * (1 if c >= 0 else -1)), [])
        seq = tuple(base[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], ([], []))[0].append(c)
        nodes[seq][1].append(c)
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
    kids = {s: [] for s in nodes}
    for s in nodes:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for s in sorted(nodes, key=len, reverse=True):
        leaves[s] += not kids[s]
        saved[s] += (len(nodes[s][0]) - 1) * words(s)
        if s:
            leaves[s[:-1]] += leaves[s]
            saved[s[:-1]] += saved[s]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(s), min(nodes[s[:-1]][0]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], sha(e)) for s, (m, e) in nodes.items()]


def same(got, want):
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=repr) == sorted(want, key=repr)


def case(rnd, convs, turns, words):
    rows = []
    for c in convs:
        for t in range(rnd.randint(1, turns)):
            rows.append((c, rnd.choice([t, t, t, None, 5]), rnd.choice(["user", "assistant", None, ""]), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 2))) or None, 1, "x"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = case(rnd, [*range(-45, 160), 2**62, -(2**63)], [3, 5, 9][seed], ["a", "b", "c\td", "\x85", "é"][: 2 + seed])
    rows += [(None, 1, "user", "x", 1, "x"), rows[0], rows[0]]
    same(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(7)), plain(rows))


def test_long_and_copied_conversations(spark):
    """One conversation with two thirds of all rows, split over tasks; copies of another; short ones that become turnless."""
    rows = [(3, i // 2, "user", f"w{i} x", 1, "") for i in range(3000)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"same {t}", 1, "") for c in range(1000, 1400) for t in range(3)]
    rows += [(c, 0, None, None, 1, "") for c in range(41, 60)]
    same(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA)), plain(rows))


def test_digests_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "ENDS_CHARS", 100)
    rows = [(c, 0, "user", "hi", 1, "") for c in range(700)]
    same(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA)), plain(rows))


def test_turnless_and_single(spark):
    for rows in ([(41, 0, "user", "x", 1, "")], [(c, 0, "user", "x", 1, "") for c in range(41, 60)], [(0, None, None, None, 1, "")]):
        same(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA)), plain(rows))


def test_paths_are_few_above_a_node(spark):
    rnd = random.Random(9)
    rows = case(rnd, range(400), 6, ["a", "b"])
    members = conversation_trie.rebuilt(conversation_trie.numbered(spark.createDataFrame(rows, SCHEMA)))
    assert members.where("depth = 0").count() == len({r[0] for r in rows})
    assert members.groupBy("conv_id", "depth").count().where("count > 1").count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op13_conversation_trie"](spark, sf), plain(rows))


def test_sql(spark, sf):
    name = "op13_conversation_trie"
    assert difference(spark, sf, name, QUERIES[name], ORACLE_SQL[name]) is None
