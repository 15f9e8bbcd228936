"""Token counts by finite-state tokenizer compilation (operator 1).

A byte-level BPE vocabulary is compiled into two deterministic transducers.

* The outer one reads code points and cuts the text into pretokens. Each of its arcs (a pretoken)
  is annotated with the number of tokens that it emits; arcs are determinised when first walked and
  kept in a bounded memo.
* The inner one gives an arc its annotation. It reads the bytes of a pretoken; after each byte its
  state is the last token of the prefix's encoding, which is unique: the longest vocabulary suffix
  whose junction with the last token before it is stable, that is, at which no merge would fire. Each
  transition carries the change of the emitted count. A byte costs a bounded number of look-ups, so a
  pretoken takes linear time however long it is, where merging by rank takes quadratic time.

A long text is read in chunks. Each chunk gives a state map: the part before its first
synchronising point (a white-space character after another character, where a pretoken always
starts whatever came before), the tokens between its first and last such points, and the part after
the last. Maps compose associatively, so a text's count is the end of a prefix scan over its chunks,
done as a balanced tree.

Edge cases: a null text counts as empty, with 0 bytes and 0 tokens; repeated rows each have a row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm.common import blocks, documents

CHUNK_CHARS = 1 << 16
MEMO_ARCS = 600_000
#: The pretoken pattern of the byte-level vocabulary and its white space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SYNC = r"(?<=\S)(?=\s)"


def byte_alphabet() -> dict[str, int]:
    """Byte of each printable character in which byte-level vocabularies write their tokens."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenTransducer:
    """The compiled vocabulary. ``count(text)`` is the number of tokens of a whole text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: Tokens by merge rank: the 256 bytes, then the merges in order.
        self.rank = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = as_bytes(left), as_bytes(right)
            pair = (self.rank[a], self.rank[b])
            self.joined[pair] = self.rank[a + b] = len(self.parts)
            self.parts.append(pair)
        self.longest = max(map(len, self.rank))
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pretokens = regex.compile(PRETOKEN)
        self.sync = regex.compile(SYNC)
        self.stable: dict[int, bool] = {}
        outer = self

        class Arcs(dict):
            def __missing__(self, pretoken: str) -> int:
                if len(self) >= MEMO_ARCS:
                    self.clear()
                n = outer.emitted(pretoken.encode())
                if len(pretoken) <= 64:
                    self[pretoken] = n
                return n

        self.arcs = Arcs()

    def junction(self, a: int, b: int) -> bool:
        """Whether token a followed by token b stays so: no merge fires over the border before both
        are complete. Merges inside a and b are undone from the latest on; at each step the two
        tokens that meet at the border must not have a merge that ranks before the step undone."""
        key = a << 20 | b
        known = self.stable.get(key)
        if known is not None:
            return known
        parts, joined, before, good = self.parts, self.joined, len(self.parts), True
        while True:
            made = joined.get((a, b))
            if made is not None and made < before:
                good = False
                break
            if a < 256 and b < 256:
                break
            if a > b:  # undo the later of the two; of two alike the left one was made first
                before, a = a, parts[a][1]
            else:
                before, b = b + 1, parts[b][0]
        if len(self.stable) >= MEMO_ARCS:
            self.stable.clear()
        self.stable[key] = good
        return good

    def emitted(self, word: bytes) -> int:
        """Runs the inner transducer over one pretoken and returns the count in its last state. Only the
        states that the last one depends on are made; a long pretoken makes all, from left to right."""
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n) if n > 200 else ():
            self._state(word, i, last, count)
        self._state(word, n, last, count)
        return count[n]

    def _state(self, word: bytes, i: int, last: list[int], count: list[int]) -> None:
        rank, stable = self.rank, self.stable
        for j in range(i - self.longest if i > self.longest else 0, i):
            t = rank.get(word[j:i])
            if t is None:
                continue
            if j:
                if last[j] < 0:
                    self._state(word, j, last, count)
                good = stable.get(last[j] << 20 | t)
                if good is None:
                    good = self.junction(last[j], t)
                if not good:
                    continue
            last[i], count[i] = t, count[j] + 1
            return

    def _walk(self, piece: str) -> int:
        return sum(map(self.arcs.__getitem__, self.pretokens.findall(piece)))

    def state_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(before the first synchronising point, tokens from there to the last, after the last). The
        count is None where the chunk has no such point: all of it is then in the first part."""
        first = self.sync.search(chunk)
        if first is None:
            return chunk, None, ""
        end = len(chunk)
        while end > 0 and chunk[end - 1].isspace():
            end -= 1
        # the last point may start the white space at the very end, or else the last word's
        last = self.sync.search(chunk, max(first.start(), end - 1)) if end < len(chunk) else None
        if last is None:
            k = end
            while k > first.start() and not chunk[k - 1].isspace():
                k -= 1
            while k > first.start() and chunk[k - 1].isspace():
                k -= 1
            last = self.sync.search(chunk, max(first.start(), k - 1)) or first
        return chunk[: first.start()], self._walk(chunk[first.start() : last.start()]), chunk[last.start() :]

    def compose(self, f: tuple, g: tuple) -> tuple:
        """The map of two neighbouring chunks; associative."""
        if f[1] is None and g[1] is None:
            return self._resynced(f[0] + g[0])
        if f[1] is None:
            head = self._resynced(f[0] + g[0])
            return (head[0], g[1], g[2]) if head[1] is None else (head[0], head[1] + self._walk(head[2]) + g[1], g[2])
        if g[1] is None:
            tail = self._resynced(f[2] + g[0])
            return (f[0], f[1], tail[0]) if tail[1] is None else (f[0], f[1] + self._walk(tail[0]) + tail[1], tail[2])
        return f[0], f[1] + self._walk(f[2] + g[0]) + g[1], g[2]

    def _resynced(self, text: str) -> tuple[str, int | None, str]:
        """Joining two parts may make a synchronising point at their border."""
        return self.state_map(text)

    def _plain(self, text: str) -> int:
        if len(text) <= CHUNK_CHARS:
            return self._walk(text)
        maps = [self.state_map(text[i : i + CHUNK_CHARS]) for i in range(0, len(text), CHUNK_CHARS)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, body, tail = maps[0]
        return self._walk(head) + (body or 0) + self._walk(tail)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


_COMPILED: dict[str, TokenTransducer] = {}


def compiled(path: str) -> TokenTransducer:
    if path not in _COMPILED:
        _COMPILED[path] = TokenTransducer(path)
    return _COMPILED[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes and n_tokens of each row; no shuffle. tokenizer: the name of a
    vocabulary file that is installed on every executor."""
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(vocabulary_path(tokenizer))
        for b in blocks(batches, column="__text"):
            tokens = [transducer.count(v) for v in b.column("__text")]
            yield pa.RecordBatch.from_arrays([*(b.batch.column(c) for c in keep), pa.array(np.diff(b.at), pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(count, schema)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 1024)
