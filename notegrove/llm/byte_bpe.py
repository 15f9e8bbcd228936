"""Byte-level BPE encoding and decoding (operator 12).

A vocabulary of ranks is compiled once a worker. Its tokens, as Latin-1 strings (a character a byte), go into an Aho-Corasick
automaton; from the ranks follow each token's last merge, its longest proper prefix among the tokens, and with the merges
whether two tokens may stand side by side: undoing the merges next to their border from the latest on, none may have joined
over the border before.

One pass of the automaton over a piece gives the longest token at every position. The encoder takes the longest token that may
follow the one before it; where none does, the position is closed for good and it goes back to the next shorter token before.
A position is closed once at most, so the work is linear in the length, and the result is the one that merging by rank gives.

Texts are cut into pieces by the tokenizer's pattern, long ones chunk by chunk at places where a piece always begins, so what a
task holds is bounded by its longest text. No row is shuffled.

Edge cases: a null or empty text has no ids (an empty binary) and decodes to no bytes; null ids decode to null; repeated rows
each have a row; an empty table gives none; other columns are passed on only if they are named in ``keep``, and a new column
takes underscores before its name where that is taken. A vocabulary without all 256 bytes, or with a token that merges of
lower ranks do not make, is refused, as is an id that the vocabulary does not have.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm.common import blocks, documents, free
from notegrove.llm.token_counts import SYNC, vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS = 1 << 16
#: Entries of a worker's memos, and the longest piece that is kept.
MEMO_PIECES, MEMO_PAIRS, MEMO_CHARS = 1 << 18, 1 << 20, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of a short piece after all merges of a lower rank than ``below``, the lowest rank first, then the leftmost."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class ByteBpe:
    """``encode`` gives a text's ids as little-endian unsigned 32-bit integers, ``decode`` the bytes of such ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.pieces, self.sync = regex.compile(pattern), regex.compile(SYNC)
        size = max(ranks.values()) + 1
        self.token: list[bytes | None] = [None] * size
        self.length, self.shorter = [0] * size, [-1] * size
        self.last_merge: list[tuple[int, int] | None] = [None] * size
        self.made: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.token[rank], self.length[rank] = token, len(token)
            self.shorter[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
            self.automaton.add_word(token.decode("latin-1"), rank)
            if len(token) > 1:
                parts = merged(token, ranks, rank)
                if len(parts) != 2 or any(len(p) > 1 and ranks[p] >= rank for p in parts):
                    raise ValueError(f"merges of lower ranks do not make token {rank}")
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.last_merge[rank] = pair
                self.made[pair] = rank
        self.automaton.make_automaton()
        outer = self

        class Pairs(dict):
            def __missing__(self, pair: tuple[int, int]) -> bool:
                if len(self) >= MEMO_PAIRS:
                    self.clear()
                self[pair] = good = outer.fits(*pair)
                return good

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= MEMO_PIECES:
                    self.clear()
                ids = np.array(outer.piece_ids(piece.encode()), "<u4").tobytes()
                if len(piece) <= MEMO_CHARS:
                    self[piece] = ids
                return ids

        self.pairs, self.memo = Pairs(), Pieces()

    def fits(self, a: int, b: int) -> bool:
        """Whether token a directly before token b stays so."""
        before, made, parts = len(self.token), self.made, self.last_merge
        while True:
            if made.get((a, b), before) < before:
                return False
            if parts[a] is None and parts[b] is None:
                return True
            if parts[b] is None or (parts[a] is not None and a > b):
                before, a = a, parts[a][1]
            else:  # of two alike the left one was made first
                before, b = b + 1, parts[b][0]

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter, pairs = len(piece), self.length, self.shorter, self.pairs
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends come in order, so the longest is the last one written
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not closed[end] and (not out or pairs[out[-1], token]):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            if token < 0:
                closed[at] = 1
                token = out.pop()
                at -= length[token]

    def chunks(self, text: str) -> Iterator[str]:
        """The text in parts of about CHUNK_CHARS, each of which ends before a white-space character that follows another
        character: a piece always begins there."""
        begin = 0
        while len(text) - begin > CHUNK_CHARS and (cut := self.sync.search(text, begin + CHUNK_CHARS)):
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:] if begin else text

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(b"".join(map(self.memo.__getitem__, self.pieces.findall(chunk))) for chunk in self.chunks(text))

    def decode(self, ids: bytes | None) -> bytes | None:
        if ids is None:
            return None
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_COMPILED: dict[str, ByteBpe] = {}


def compiled(name: str) -> ByteBpe:
    if name not in _COMPILED:
        import public_tokenizers

        _COMPILED[name] = ByteBpe(read_ranks(vocabulary_path(name)), public_tokenizers.PATTERN)
    return _COMPILED[name]


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ids (binary, four bytes an id, as token shards store them) of each row. vocabulary: the name of a
    file of ranks that is installed on every executor."""
    ids, source = free("ids", list(keep)), free("text", list(keep))
    schema = docs.select(*keep).schema.add(ids, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(vocabulary)
        for b in blocks(batches, column=source):
            yield pa.RecordBatch.from_arrays([*(b.batch.column(c) for c in keep), pa.array(map(bpe.encode, b.column(source)), pa.binary())], names=[*keep, ids])

    return docs.select(*keep, F.col(text).alias(source)).mapInArrow(run, schema)


def decoded(frame: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and decoded (binary: ids may end inside a character) of each row."""
    name = free("decoded", list(keep))
    schema = frame.select(*keep).schema.add(name, "binary")
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(vocabulary)
        for batch in batches:
            for row in range(0, len(batch), 64):
                b = batch.slice(row, 64)
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(map(bpe.decode, b.column(at).to_pylist()), pa.binary())], names=[*keep, name])

    return frame.select(*keep, ids).mapInArrow(run, schema)


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    both = decoded(encoded(documents(spark, sf_dir)), keep=("doc_id", "ids"))
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
