"""License scans by winnowed fingerprints and banded alignment (operator 10).

The templates' winnowed word shingles are an inverted index; of a template of at most ``SHORT`` words all are, and
shorter parts too, one of which is whole in any match that lacks words. A text's shingles that meet it give
seeds, each a template and a diagonal (place in the text less place in the template). Seeds of one
template whose diagonals lie within the band of each other are one candidate; its stretch of the text is, until nothing more matches, aligned with the
template inside the band (edit distance over words that is free to start and end anywhere in the
text), and the match is reported with its coverage, the share of the template's words that the
alignment matches, and its span in words.

Edge cases: null and empty texts have no matches; overlapping matches of several templates are all
reported, of one template the best; repeated rows each have a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm.common import Block, blocks, byte_class, documents, free, grams, inside

SHINGLE = 3
WINNOW = 2
BAND = 8
SHORT = 12
COVERAGE = 0.8
_WORD = byte_class("alnum")
#: Notices of common licenses, by SPDX identifier.
NOTICES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LicenseRef-reserved": "All rights reserved.",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Whole texts of licenses, in ``licenses``; each is a template besides the license's notices.
TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
TEMPLATES = NOTICES | {f"{name}-text": pkgutil.get_data("notegrove.llm", f"licenses/{name}.txt").decode() for name in TEXTS}


def _winnowed(w: np.ndarray) -> list[int]:
    """Places of a template's fingerprints: of every WINNOW consecutive shingles the smallest. Phrases that it repeats are left out
    where enough others remain: they put most of their seeds on diagonals far from the match."""
    g = grams(w, SHINGLE)
    chosen = {i + int(np.argmin(g[i : i + WINNOW])) for i in range(max(1, len(g) - WINNOW + 1))} if len(g) else set()
    own, times = np.unique(g, return_counts=True)
    once = set(own[times == 1].tolist())
    single = {i for i in chosen if int(g[i]) in once}
    return sorted(single if 2 * len(single) >= len(chosen) else chosen)


def _short(m: int, coverage: float) -> list[tuple[int, int]]:
    """(length, place) of the seeds of a template of m words, too few to thin them out: every shingle, and parts so many that one
    is whole in any text that lacks no more words than the coverage allows."""
    parts = m - int(np.ceil(coverage * m - 1e-9)) + 1
    edges = [i * m // parts for i in range(parts + 1)]
    return sorted({(SHINGLE, i) for i in range(m - SHINGLE + 1)} | {(min(SHINGLE, j - i), i) for i, j in zip(edges[:-1], edges[1:], strict=True) if i < j})


class TemplateIndex:
    """Templates by their seeds: runs of words, of several lengths, each with the templates and places that have it."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.words: list[np.ndarray] = []
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        batch = pa.RecordBatch.from_pydict({"text": pa.array([templates[n] for n in self.names], pa.large_string())})
        for b in blocks(iter([batch]), lower=True, limit=1 << 30):
            starts, ends, at = b.runs(_WORD)
            h = b.hashes(starts, ends)
            for t in range(b.n):
                w = h[at[t] : at[t + 1]]
                self.words.append(w)
                for n, i in _short(len(w), coverage) if len(w) <= SHORT else ((SHINGLE, i) for i in _winnowed(w)):
                    seeds.setdefault(n, {}).setdefault(int(grams(w[i : i + n], n)[0]), []).append((t, i))
        #: By length of seed: its hashes in order, and what each is a seed of.
        self.seeds = {n: (np.array(sorted(x), np.uint64), [x[k] for k in sorted(x)]) for n, x in sorted(seeds.items())}
        self.memo: dict[tuple, tuple] = {}

    def most(self, t: int, text: np.ndarray) -> int:
        """At most so many words can an alignment match: those that the text holds anywhere inside the band."""
        w = self.words[t]
        m, n = len(w), len(text)
        held = np.zeros(m, bool)
        for d in range(-BAND - 1, max(n - m, 0) + BAND + 1):
            i, j = max(0, -d), min(m, n - d)
            if i < j:
                held[i:j] |= w[i:j] == text[i + d : j + d]
        return int(held.sum())

    def align(self, t: int, text: np.ndarray) -> tuple[int, int, int]:
        """(matched words, first, after the last) of the best alignment of a template in a stretch of text;
        cells farther than the band from the stretch's diagonals are not visited."""
        key = (t, text.tobytes())
        if key in self.memo:
            return self.memo[key]
        w = self.words[t]
        m, n = len(w), len(text)
        width = n - m if n > m else 0
        # best[j]: (cost, -matched, start) of aligning the first i template words to text ending at j
        best = [(0, 0, j) for j in range(n + 1)]
        for i in range(1, m + 1):
            new = [(1 << 30, 0, 0)] * (n + 1)
            for j in range(max(0, i - BAND), min(n, i + width + BAND) + 1):
                opts = [(best[j][0] + 1, best[j][1], best[j][2])]
                if j:
                    same = w[i - 1] == text[j - 1]
                    c, k, s = best[j - 1]
                    opts.append((c + (0 if same else 1), k - int(same), s))
                    c, k, s = new[j - 1]
                    opts.append((c + 1, k, s))
                new[j] = min(opts)
            best = new
        j = min(range(n + 1), key=lambda x: (best[x], x))
        out = (-best[j][1], best[j][2], j)
        if len(self.memo) > 50_000:
            self.memo.clear()
        self.memo[key] = out
        return out

    def find(self, b: Block, coverage: float = COVERAGE) -> list[list[tuple[int, int, str, float]]]:
        """(first word, after the last, name, coverage) of each text's matches, in order."""
        starts, ends, at = b.runs(_WORD)
        out: list[list] = [[] for _ in range(b.n)]
        h = b.hashes(starts, ends)
        groups: dict[tuple[int, int], list[int]] = {}
        for n, (keys, places) in self.seeds.items():
            if len(h) < n:
                continue
            g = grams(h, n)
            k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = np.intersect1d(np.flatnonzero(keys[k] == g), inside(at, n), assume_unique=True)
            row = np.searchsorted(at, hit, "right") - 1
            for r, p in zip(row.tolist(), hit.tolist(), strict=True):
                for t, i in places[k[p]]:
                    groups.setdefault((r, t), []).append(p - int(at[r]) - i)
        near: dict[tuple[int, int], set[tuple[int, int, float]]] = {}
        for (r, t), diagonals in groups.items():
            near[r, t] = set()
            diagonals.sort()
            cluster = [diagonals[0]]
            for d in [*diagonals[1:], None]:
                if d is not None and d - cluster[0] <= BAND:
                    cluster.append(d)
                    continue
                lo = max(0, cluster[0] - BAND)
                hi = min(int(at[r + 1] - at[r]), cluster[-1] + len(self.words[t]) + BAND)
                todo = [(lo, hi)]
                while todo:
                    lo, hi = todo.pop()
                    stretch = h[at[r] + lo : at[r] + hi]
                    if self.most(t, stretch) < coverage * len(self.words[t]):
                        continue
                    matched, s, e = self.align(t, stretch)
                    share = matched / len(self.words[t])
                    if share >= coverage:
                        near[r, t].add((lo + s, lo + e, share))
                        # a notice may follow itself within the band: what lies on both sides is aligned again
                        todo += [(lo, lo + s), (lo + e, hi)]
                cluster = [d]
            # stretches of neighbouring candidates overlap: of overlapping matches of a template the best one stays
            taken = np.zeros(int(at[r + 1] - at[r]), bool)
            for s, e, share in sorted(near[r, t], key=lambda m: (-m[2], m[1] - m[0], m)):
                if not taken[s:e].any():
                    taken[s:e] = True
                    out[r].append((s, e, self.names[t], share))
        return [sorted(x) for x in out]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and matches (array of first_word, end_word, license, coverage) of every row; no shuffle."""
    from pyspark.sql import types as T

    templates = TEMPLATES if templates is None else templates
    match = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType())])
    schema = docs.select(*keep).schema.add("matches", T.ArrayType(match))
    read = free("text", schema.names)
    arrow = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, coverage)
        for b in blocks(batches, lower=True, column=read):
            found = [[dict(zip(("first_word", "end_word", "license", "coverage"), m, strict=True)) for m in x] for x in index.find(b, coverage)]
            yield pa.RecordBatch.from_arrays([*(b.batch.column(c) for c in keep), pa.array(found, arrow)], names=[*keep, "matches"])

    return docs.select(*keep, F.col(text).alias(read)).mapInArrow(run, schema)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("max_coverage"),
        F.array_join(F.transform("matches", lambda m: F.format_string("%s:%d:%d", m["license"], m["first_word"], m["end_word"])), ",").alias("spans"),
    )
