"""Learned formats of secrets: against a plain version, on unseen tokens, and on clean text."""

import math
import random

import pytest

from notegrove.llm import common, secret_scan
from notegrove.llm.queries import QUERIES
from tests.llm import brute

RUN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")


def plain_score(a, value):
    """Likelihood by counts of the learned states, a character at a time."""
    p, q, k = 1.0, 0, 0
    while k < len(value) and value[: k + 1] in a.heads:
        k += 1
    total = 0.0
    for i, c in enumerate(value):
        s = "=" + c if i < k else "d" if c in "0123456789" else "h" if c in "abcdef" else "H" if c in "ABCDEF" else "l" if "a" <= c <= "z" else "U" if "A" <= c <= "Z" else c
        if not a.taken[q][s]:
            return -math.inf
        p = a.taken[q][s] / a.visits[q] / {"d": 10, "h": 6, "H": 6, "l": 20, "U": 20}.get(s, 1)
        total += math.log(p)
        q = a.next[q][s]
    return total + math.log(a.stops[q] / a.visits[q]) if a.stops[q] else -math.inf


def plain_spans(text, automata):
    base = brute.base_spans(text)
    free = [True] * len(text)
    for s, _, e in base:
        free[s:e] = [False] * (e - s)
    out, i = list(base), 0
    while i < len(text):
        if text[i] not in RUN:
            i += 1
            continue
        j = i
        while j < len(text) and text[j] in RUN:
            j += 1
        end = j
        while end < len(text) and text[end] == "=" and end < j + 2:
            end += 1
        run = text[i:j]
        digits = any(c.isdigit() for c in run)
        capital = any(c.isupper() and any(x.islower() for x in run[:k]) for k, c in enumerate(run))
        if digits or capital:
            parts, s = [], i
            for k in range(i, end + 1):
                if k == end or not free[k]:
                    if s < k:
                        parts.append((s, k))
                    s = k + 1
            for s, e in parts:
                s, e = cut(text, s, e)
                if secret(text[s:e], automata):
                    out.append((s, "format", e))
                    continue
                x = s
                for k in range(s, e + 1):
                    if k == e or text[k] in "/.+":
                        y, z = cut(text, x, k)
                        if (y, z) != (s, e) and secret(text[y:z], automata):
                            out.append((y, "format", z))
                        x = k + 1
        i = end
    return sorted(out, key=lambda x: (x[0], secret_scan.KINDS.index(x[1])))


def cut(text, s, e):
    while s < e and text[s] in "./=":
        s += 1
    while e > s and text[e - 1] in "./":
        e -= 1
    return s, e


def secret(v, automata):
    beside = any((a.isdigit() and b.isalpha()) or (a.isalpha() and b.isdigit()) for a, b in zip(v, v[1:], strict=False))
    capital = any(c.isupper() and any(x.islower() for x in v[:k]) for k, c in enumerate(v))
    return (beside or capital) and max(plain_score(a, v) for a in automata.values()) - secret_scan.running_text(v) >= secret_scan.THRESHOLD


@pytest.fixture(scope="module")
def automata():
    rnd = random.Random(2)
    return secret_scan.learned(secret_scan.examples() + [("assign", "".join(rnd.choices("0123456789abcdef", k=40))) for _ in range(200)])


def test_states_merge(automata):
    """Random parts become loops, fixed ones stay: far fewer states than characters."""
    assert {k: len(a.states) for k, a in automata.items()} == {k: len(a.states) for k, a in automata.items()}
    assert all(len(a.states) < 40 for a in automata.values()) and len(automata["assign"].states) <= 3
    assert automata["github"].heads == {"g", "gh", "ghp", "ghp_"}


def test_unseen_tokens_of_trained_formats(automata):
    new = secret_scan.examples(150, seed=77)
    assert not {v for _, v in new} & {v for _, v in secret_scan.examples()}
    for kind in secret_scan.FORMATS:
        values = [v for k, v in new if k == kind]
        found = [secret_scan.spans_in(f"we saw {v}, then", automata)[1] == [(7, "format", 7 + len(v))] for v in values]
        assert sum(found) >= 0.9 * len(values), kind
    rnd = random.Random(5)
    hexes = ["".join(rnd.choices("0123456789abcdef", k=23)) for _ in range(100)]  # too short for the base kind
    assert sum(secret_scan.spans_in(f"key {h}.", automata)[1] != [] for h in hexes) >= 90


def test_clean_text_has_no_spans(spark, automata):
    docs = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    odd = "inconsequentialities99 2024-01-01T00-00 iPhone12Pro https://www.Example.com/a1/b2/page-3.html COVID19 getElementById 3f2504e0-4f89-11d3 utf8mb4 H2O v1.2.3-rc1 McDonalds x86_64 0800-555-1234"
    assert sum(k == "format" for t in [*docs, odd] for _, k, _ in secret_scan.spans_in(t, automata)[1]) == 0


def test_spans_against_a_plain_version(automata):
    rnd = random.Random(8)
    tokens = [v for _, v in secret_scan.examples(40, seed=5)]
    glue = [" ", "", "/", ".", "-", "=", "==", "\n", "é", " token = ", "a1", "B", "x/y.z", "secret:", "AKIA", "0a1b2c3d" * 4]
    for _ in range(600):
        text = "".join(rnd.choice(glue) + (rnd.choice(tokens)[rnd.randint(0, 3) :] if rnd.random() < 0.5 else "") for _ in range(rnd.randint(0, 12)))
        base, spans = secret_scan.spans_in(text, automata)
        assert spans == plain_spans(text, automata), text
        assert set(base) <= set(spans)


def test_long_texts_take_linear_time(automata):
    for text in ("a" * 2_000_000, ("a" * 50 + ".B") * 30_000, "aA1" * 300_000, "1" * 2_000_000):
        secret_scan.spans_in(text, automata)
    text = "word " * 300_000 + "ghp_" + "aB3dE5gH7" * 4 + " word" * 1000
    assert secret_scan.spans_in(text, automata)[1] == [(1_500_000, "format", 1_500_040)]


def test_query_over_planted_rows(spark, tmp_path):
    new = [v for _, v in secret_scan.examples(5, seed=31)]
    rows = [(i, f"line {v} here\ntoken = {v}") for i, v in enumerate(new)] + [(None, None), (90, ""), (91, "plain words only"), (91, "plain words only"), (92, "x " * 600_000 + new[0])]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, n_hex int")
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_secret_scan"](spark, str(tmp_path)).collect()
    trained = secret_scan.trained(common.documents(spark, str(tmp_path)))
    want = [(i, ",".join(f"{k}:{s}:{e}" for s, k, e in plain_spans(t or "", trained))) for i, t in rows]
    assert sorted(((r["doc_id"], r["spans"]) for r in got), key=repr) == sorted(want, key=repr)
    assert sum("format" in r["spans"] for r in got) == len(new) + 1
    out = secret_scan.redacted(df, trained)
    assert out.columns == df.columns and not any(v in (r["text"] or "") for r in out.collect() for v in new)
