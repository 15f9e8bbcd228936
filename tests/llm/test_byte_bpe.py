"""Byte-level BPE against the tiktoken library, and its round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from notegrove.llm import byte_bpe
from notegrove.llm.queries import QUERIES

NAMES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def library(name):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(name))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def texts():
    rnd = random.Random(11)
    out = [None, "", " ", "\n\n \t", "a", "aaaaaaaaaaaaaaaaaaaa", "<|endoftext|> x", "it's we'll  I'M", "\x1c\x85\xa0 x", "日本語 テスト", "é🙂🙂", "\x00�"]
    out += ["".join(rnd.choice("ab") for _ in range(n)) for n in (50, 3_000)]
    out += ["".join(rnd.choice("the quick brown ſïéß日本🙂12 \n\t.,!") for _ in range(4_000)) for _ in range(20)]
    out += [" ".join("".join(rnd.choice("aeiounrtsl") for _ in range(rnd.randint(1, 14))) for _ in range(2_000))]
    return out


@pytest.mark.parametrize("name", NAMES)
def test_ids(name):
    bpe, lib = byte_bpe.compiled(name), library(name)
    for t in texts():
        ids = bpe.encode(t)
        assert ids == packed(lib.encode_ordinary(t or "")), t
        assert bpe.decode(ids) == (t or "").encode()


def test_every_pair_of_tokens():
    """Two tokens fit exactly if the library encodes their bytes so, for random pairs as one piece."""
    bpe, rnd = byte_bpe.compiled(NAMES[0]), random.Random(3)
    core = library(NAMES[0])._core_bpe
    some = [t for t in bpe.token if t.isalpha()]
    for _ in range(4_000):
        a, b = rnd.choice(some), rnd.choice(some)
        if a + b not in bpe.ranks:
            assert bpe.fits(bpe.ranks[a], bpe.ranks[b]) == (core.encode_single_piece(a + b) == [bpe.ranks[a], bpe.ranks[b]]), (a, b)


def test_code_points():
    bpe, lib = byte_bpe.compiled(NAMES[0]), library(NAMES[0])
    text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} x" for c in range(0, 0x11000, 7) if not 0xD800 <= c < 0xE000)
    assert bpe.encode(text) == packed(lib.encode_ordinary(text))


def test_long_texts(monkeypatch):
    bpe, lib = byte_bpe.compiled(NAMES[0]), library(NAMES[0])
    prose = "\n ".join(t for t in texts() if t)
    assert len(prose) > byte_bpe.CHUNK_CHARS
    run = "ab" * 100_000  # one piece without any place to cut
    for t in (prose, run, " " * 150_000 + "x", prose + " " * 90_000):
        assert bpe.encode(t) == packed(lib.encode_ordinary(t))
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 3)
    for t in (prose, "a  b   c \n d", "  x"):
        assert bpe.encode(t) == packed(lib.encode_ordinary(t))


def test_refused():
    ranks = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.ByteBpe({b"a": 0}, public_tokenizers.PATTERN)
    with pytest.raises(ValueError, match="lower ranks"):
        byte_bpe.ByteBpe(ranks | {b"abc": 256}, public_tokenizers.PATTERN)


def test_frames(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, "no id", None, None), (3, "\n\n \t", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").repartition(3)
    lib = library(NAMES[0])
    ids = byte_bpe.encoded(docs, keep=("doc_id", "ids", "text"))
    assert ids.columns == ["doc_id", "ids", "text", "_ids"]
    back = byte_bpe.decoded(ids, ids="_ids", keep=("doc_id", "text", "_ids")).collect()
    assert len(back) == len(rows)
    for r in back:
        assert bytes(r["_ids"]) == packed(lib.encode_ordinary(r["text"] or ""))
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    null = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decoded(null).first()["decoded"] is None


def test_query(spark, sf):
    lib = library(NAMES[0])
    want = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_byte_bpe"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        ids = lib.encode_ordinary(want[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
