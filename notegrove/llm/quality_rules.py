"""Quality rules as a short-circuit cascade (operator 3).

Every rule can reject a document on its own, so the verdict does not depend on their order; the cost
does. Each task runs all rules once on the first texts that it reads (at most ``SAMPLE_BYTES``, a
sample whose size is fixed), measures each rule's time and the share that it rejects, and orders the
rules by rejection per cost. From then on a rule sees only what all rules before it have passed: the
block is cut down to the survivors before the next rule runs.

Edge cases: a null or empty text has no words and fails the base rule; repeated rows each have a row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm.common import Block, blocks, byte_class, covered, documents, grams, inside, mix, row_of

SAMPLE_BYTES = 1 << 20
#: The symbols counted by the base features.
SYMBOLS = b"#*$%&|<>"
_WORD = byte_class("space")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _BANG, _UPPER, _LETTER = _table(SYMBOLS), _table(b"!?"), _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def tally(block: Block, flags: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[block.at[1:]] - c[block.at[:-1]]


class Features:
    """Lazily computed counts of a block's texts; each is made at most once."""

    def __init__(self, block: Block):
        self.block, self._got = block, {}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._got:
            self._got[name] = getattr(type(self), f"_make_{name}")(self)
        return self._got[name]

    def _make_runs(self):
        return self.block.runs(_WORD)

    def _make_prefix(self):
        return self.block.prefix()

    def _make_words(self):
        starts, ends, _ = self.runs
        return self.block.hashes(starts, ends, self.prefix)

    def _make_n_words(self):
        return np.diff(self.runs[2])

    def _make_word_chars(self):
        return tally(self.block, (_WORD & _HEAD)[self.block.data])

    def _make_n_symbols(self):
        return tally(self.block, _SYMBOL[self.block.data])

    def _make_n_bangs(self):
        return tally(self.block, _BANG[self.block.data])

    def _make_n_upper(self):
        return tally(self.block, _UPPER[self.block.data])

    def _make_n_letters(self):
        return tally(self.block, _LETTER[self.block.data])

    def _make_lines(self):
        """(row, hash) of each line that has a word."""
        b = self.block
        feeds = np.flatnonzero(b.data == 10)
        starts = np.sort(np.concatenate([b.at[:-1], feeds + 1]))
        # a feed at a text's end starts an empty line, which has no word; an empty text is one too
        ends = np.append(starts[1:], len(b.data))
        ends = ends - ((ends > starts) & (b.data[np.maximum(ends - 1, 0)] == 10)) if len(b.data) else ends
        first = self.runs[0]
        worded = np.searchsorted(first, ends) > np.searchsorted(first, starts)
        starts, ends = starts[worded], ends[worded]
        row = np.searchsorted(b.at, starts, "right") - 1
        return row, b.hashes(starts, ends, self.prefix)

    def _make_n_lines(self):
        return np.bincount(self.lines[0], minlength=self.block.n)

    def _make_n_dup_lines(self):
        row, h = self.lines
        key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        return self.n_lines - np.bincount(row[first], minlength=self.block.n)

    def _make_n_repeat_words(self):
        at = self.runs[2]
        pos = inside(at, 3)
        if not len(pos):
            return np.zeros(self.block.n, np.int64)
        row = row_of(at)
        key = mix(grams(self.words, 3)[pos] + row[pos].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        often = np.zeros(len(key), bool)
        often[order[1:][same]] = often[order[:-1][same]] = True
        hit = covered(int(at[-1]), pos[often], pos[often] + 3)
        return np.bincount(row[hit], minlength=self.block.n)

    def _make_top_word(self):
        """Occurrences of each text's most frequent word."""
        row = row_of(self.runs[2])
        out = np.zeros(self.block.n, np.int64)
        if len(row):
            key, count = np.unique(mix(self.words + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_counts=True)
            pos = np.searchsorted(key, mix(self.words + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            np.maximum.at(out, row, count[pos])
        return out


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the features of a block and says which texts fail."""

    name: str
    rejects: Callable[[Features], np.ndarray]


def production_rules() -> list[Rule]:
    return [
        Rule("symbol_density", lambda f: 100 * f.n_symbols > 20 * f.n_words),
        Rule("exclamations", lambda f: 100 * f.n_bangs > 40 * f.n_words),
        Rule("upper_case", lambda f: 100 * f.n_upper > 60 * f.n_letters),
        Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 20 * f.n_words)),
        Rule("duplicate_lines", lambda f: 100 * f.n_dup_lines > 30 * f.n_lines),
        Rule("dominant_word", lambda f: 100 * f.top_word > 30 * f.n_words),
    ]


def cut_down(block: Block, rows: np.ndarray) -> Block:
    """The block's texts of these rows."""
    keep = np.zeros(block.n, bool)
    keep[rows] = True
    size = np.diff(block.at)
    at = np.concatenate([[0], np.cumsum(size[rows])])
    return Block(block.batch.take(pa.array(rows)), block.raw[np.repeat(keep, size)], at, False)


class Cascade:
    def __init__(self, rules: list[Rule]):
        self.rules, self.order = rules, None

    def measure(self, block: Block) -> None:
        """Orders the rules by rejection per cost on this sample; each is timed from fresh features."""
        merit = []
        for k, r in enumerate(self.rules):
            began = time.perf_counter()
            share = float(np.mean(r.rejects(Features(block)))) if block.n else 0.0
            merit.append((-(share + 1e-6) / max(time.perf_counter() - began, 1e-9), k))
        self.order = [k for _, k in sorted(merit)]

    def passed(self, block: Block) -> np.ndarray:
        """Which texts pass every rule."""
        if self.order is None:
            self.measure(block)
        left, now = np.arange(block.n), block
        features = Features(now)
        for k in self.order:
            if not len(left):
                break
            bad = self.rules[k].rejects(features)
            if bad.any():
                left = left[~bad]
                now = cut_down(now, np.flatnonzero(~bad))
                features = Features(now)
        out = np.zeros(block.n, bool)
        out[left] = True
        return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, rules: Callable[[], list[Rule]] = production_rules, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the base features, base_failed and kept of each row; no shuffle."""
    schema = docs.select(*keep).schema
    for c in BASE:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules())
        for b in blocks(batches, column="__text", limit=SAMPLE_BYTES):
            f = Features(b)
            base = [getattr(f, c) for c in BASE]
            failed = (f.n_words < 50) | (100 * f.n_repeat_words > 50 * f.n_words)
            kept = ~failed
            rows = np.flatnonzero(kept)
            if len(rows):
                kept[rows] = cascade.passed(b if len(rows) == b.n else cut_down(b, rows))
            yield pa.RecordBatch.from_arrays([*(b.batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in base), pa.array(failed), pa.array(kept)], names=[*keep, *BASE, "base_failed", "kept"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
