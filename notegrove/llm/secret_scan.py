"""Secret scans by grammar inference (operator 4).

Base kinds are found by fixed patterns. Their matches, and a few examples of published token formats (``EXAMPLES``), are
labelled credentials; callers may pass their own. From each kind a probabilistic automaton is learned: a prefix tree over
the credentials' characters, whose states merge while their stop and branch frequencies are compatible under the Hoeffding
bound (red states are final, blue ones their children, as in the usual state-merging learner). A character is read as its
class (digit, a-f, g-z, A-F, G-Z, or itself where it is punctuation), and as itself in the head of a format, that is, as long
as a good share of the credentials with the same start go on with it.

A candidate is each run of credential characters that has a digit beside a letter, or a capital after a small letter, outside
base spans: runs of letters of one case, capitalised words and plain numbers are running text. Each is scored
by the log-likelihood of its format under every automaton against that of running text (see ``running_text``); one over the
threshold, or if none is, each of its parts between ``/``, ``.`` and ``+``, is reported as kind ``format``.

The automata are fitted on a bounded sample: of each kind at most ``SAMPLE`` distinct credentials of at most ``LONGEST``
characters, those with the smallest hashes over all documents; everything else covers all texts.

Edge cases: a null text counts as empty; repeated rows each have a row; a corpus without credentials leaves the base
patterns and the examples; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm.common import documents, free, stored

SAMPLE = 300
LONGEST = 512
ALPHA = 0.05
#: Least log-likelihood ratio, in nats, at which a candidate is a secret: odds of e^20 to one.
THRESHOLD = 20.0
#: A character in the head of a format is literal if so many credentials share the start and this share of them goes on with it.
HEAD_LEAST, HEAD_SHARE = 10, 0.25
#: The base patterns, the group that is the credential, and its least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
KINDS = [*BASE, "format"]
#: Published token formats: literal parts, and (alphabet, length) of random ones.
ALNUM = string.ascii_letters + string.digits
FORMATS = {
    "github": ["ghp_", (ALNUM, 36)],
    "google": ["AIza", (ALNUM + "-_", 35)],
    "jwt": ["eyJ", (ALNUM, 33), ".eyJ", (ALNUM + "-_", 60), ".", (ALNUM + "-_", 43)],
    "npm": ["npm_", (ALNUM, 36)],
    "slack": ["xoxb-", (string.digits, 12), "-", (string.digits, 12), "-", (ALNUM, 24)],
    "stripe": ["sk_live_", (ALNUM, 24)],
}
EXAMPLES = 200
#: A run of credential characters that holds a digit beside a letter, or a capital after a small letter; each look-ahead
#: passes over a run once, and only where a run starts, so a long run costs its length.
_RUN = "A-Za-z0-9+/_.-"
CANDIDATE = re.compile(rf"(?<![{_RUN}])(?=[A-Za-z+/_.-]*+[0-9]|[A-Z0-9+/_.-]*+[a-z][a-z0-9+/_.-]*+[A-Z])[{_RUN}]++={{0,2}}")
_MIXED = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][^a-z]*[A-Z]")
_PIECE = re.compile(r"[^/.+]+")
_CLASS = {c: k for k, held in {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in held}
_SIZE = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}
#: Running text as a chain over small letters, capitals, digits and punctuation: log-probabilities of a start, of staying in a
#: class, of leaving it for another, and of what follows so often that it is no sign of a secret; characters are uniform in a class.
_GROUP = dict.fromkeys(string.ascii_lowercase, 0) | dict.fromkeys(string.ascii_uppercase, 1) | dict.fromkeys(string.digits, 2) | dict.fromkeys("+/_.=-", 3)
_WITHIN = [-math.log(n) for n in (26, 26, 10, 6)]
_STEP = [[math.log(0.02)] * 4 for _ in range(4)]
for _k in range(4):
    _STEP[_k][_k], _STEP[_k][3], _STEP[3][_k] = math.log(0.9), math.log(0.1), math.log(0.3)
_START = math.log(0.25)


def running_text(value: str) -> float:
    """Log-likelihood of a run as ordinary text: words, numbers, and both joined by punctuation. A capital that starts a
    word goes before small letters at no more than the cost of a word."""
    q = _GROUP[value[0]]
    total, fresh = _START + _WITHIN[q], True
    for c in value[1:]:
        g = _GROUP[c]
        total += _WITHIN[g] + (math.log(0.5) if fresh and q == 1 and g == 0 else _STEP[q][g])
        fresh = q == 3
        q = g
    return total


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, credential), ordered by start, then kind as listed."""
    out = []
    low = text.lower()
    for kind, (pattern, group, least) in BASE.items():
        if kind == "access" and "AKIA" not in text:
            continue
        if kind == "assign" and (not ("=" in text or ":" in text) or not any(k in low for k in ("passw", "secret", "token", "api"))):
            continue
        out += [(m.start(), kind, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


class Automaton:
    """A probabilistic automaton learned from strings by state merging."""

    def __init__(self, credentials: list[str], alpha: float = ALPHA):
        known = sorted(set(credentials))
        shared = Counter(v[:i] for v in known for i in range(min(map(len, known), default=0) + 1))
        #: Starts, each longer by a character, that are read literally.
        self.heads: set[str] = set()
        for s in sorted(shared, key=len):
            if s and shared[s] >= HEAD_LEAST and shared[s] >= HEAD_SHARE * shared[s[:-1]] and (len(s) == 1 or s[:-1] in self.heads):
                self.heads.add(s)
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[Counter] = [Counter()]
        self.stops, self.visits = [0], [0]
        for v in known:
            q = 0
            self.visits[0] += 1
            for c in self.symbols(v):
                self.taken[q][c] += 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.taken.append(Counter())
                    self.stops.append(0)
                    self.visits.append(0)
                q = self.next[q][c]
                self.visits[q] += 1
            self.stops[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._learn()
        #: Arcs as (log-probability of the arc and of a character of its class, next state), and of stopping.
        self.arcs = [{c: (math.log(n / self.visits[q] / _SIZE.get(c, 1)), self.next[q][c]) for c, n in self.taken[q].items()} if q in self.states else {} for q in range(len(self.next))]
        self.ends = [math.log(self.stops[q] / self.visits[q]) if self.stops[q] and q in self.states else -math.inf for q in range(len(self.next))]

    def symbols(self, value: str) -> Iterator[str]:
        """A symbol a character: itself in a literal head (marked, so that it is no class), else its class, or itself."""
        k = 0
        while value[: k + 1] in self.heads and k < len(value):
            yield "=" + value[k]
            k += 1
        for c in value[k:]:
            yield _CLASS.get(c, c)

    def _apart(self, f: int, n: int, g: int, m: int) -> bool:
        return bool(n and m) and abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if self._apart(self.stops[p], self.visits[p], self.stops[q], self.visits[q]):
                return False
            for c in self.taken[p].keys() | self.taken[q].keys():
                if self._apart(self.taken[p][c], self.visits[p], self.taken[q][c], self.visits[q]):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _distance(self, p: int, q: int) -> float:
        n, m = self.visits[p], self.visits[q]
        return (self.stops[p] / n - self.stops[q] / m) ** 2 + sum((self.taken[p][c] / n - self.taken[q][c] / m) ** 2 for c in self.taken[p].keys() | self.taken[q].keys())

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a; b's tree has no loops, so this ends."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.stops[p] += self.stops[q]
            self.visits[p] += self.visits[q]
            self.taken[p].update(self.taken[q])
            for c, child in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], child))
                else:
                    self.next[p][c] = child

    def _learn(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = sorted({(r, c) for r in red for c, q in self.next[r].items() if q not in known}, key=lambda e: (-self.visits[self.next[e[0]][e[1]]], e))
            if not blue:
                break
            r, c = blue[0]
            q = self.next[r][c]
            like = [p for p in red if self._compatible(p, q)]
            if like:  # a state that few credentials visit is compatible with many: the nearest takes it
                p = min(like, key=lambda x: self._distance(x, q))
                self.next[r][c] = p
                self._fold(p, q)
            else:
                red.append(q)
        self.states = set(red)

    def score(self, value: str) -> float:
        """Log-likelihood of a string, its end included; minus infinity for one that the automaton does not accept."""
        q, total = 0, 0.0
        for c in self.symbols(value):
            arc = self.arcs[q].get(c)
            if arc is None:
                return -math.inf
            total += arc[0]
            q = arc[1]
        return total + self.ends[q]


def examples(n: int = EXAMPLES, seed: int = 4) -> list[tuple[str, str]]:
    """(kind, credential): random ones of each published format, the same at every call."""
    rnd = random.Random(seed)
    return [(kind, "".join(p if isinstance(p, str) else "".join(rnd.choices(*p[:1], k=p[1])) for p in parts)) for kind, parts in FORMATS.items() for _ in range(n)]


def learned(labelled: list[tuple[str, str]]) -> dict[str, Automaton]:
    """An automaton for each kind of (kind, credential)."""
    by: dict[str, list[str]] = {}
    for kind, value in labelled:
        by.setdefault(kind, []).append(value)
    return {k: Automaton(v) for k, v in sorted(by.items())}


def _merged(spans: list[tuple]) -> list[tuple[int, int]]:
    """The stretches that spans, ordered by start, cover."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _outside(start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a stretch outside covered ones, which lie apart and in order."""
    k = max(0, bisect.bisect_left(covered, start, key=lambda x: x[1]))
    out = []
    while k < len(covered) and covered[k][0] < end:
        if start < covered[k][0]:
            out.append((start, covered[k][0]))
        start = max(start, covered[k][1])
        k += 1
    return [*out, (start, end)] if start < end else out


def likely(value: str, automata: dict[str, Automaton], threshold: float = THRESHOLD) -> bool:
    """Whether some automaton explains a string so much better than running text does."""
    if not _MIXED.search(value):
        return False
    least = running_text(value) + threshold
    return any(a.score(value) >= least for a in automata.values())


def spans_in(text: str, automata: dict[str, Automaton], threshold: float = THRESHOLD) -> tuple[list[tuple], list[tuple]]:
    """(base spans, all spans) of a text, as (start, kind, end)."""
    base = [s[:3] for s in base_spans(text)]
    more = []
    if automata:
        edges = _merged(base)
        for m in CANDIDATE.finditer(text):
            for s, e in _outside(m.start(), m.end(), edges) if edges else (m.span(),):
                s, e = _trimmed(text, s, e)
                if s < e and likely(text[s:e], automata, threshold):
                    more.append((s, "format", e))
                    continue
                for p in _PIECE.finditer(text, s, e):
                    x, y = _trimmed(text, *p.span())
                    if (x, y) != (s, e) and x < y and likely(text[x:y], automata, threshold):
                        more.append((x, "format", y))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """Without the full stops and slashes of the sentence or path around it."""
    while s < e and text[s] in "./=":
        s += 1
    while e > s and text[e - 1] in "./":
        e -= 1
    return s, e


def _rank(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=7).digest(), "big")


def credentials(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> list[tuple[str, str]]:
    """At most ``sample`` labelled credentials of each base kind, those of the smallest hashes. A task sends no more than so
    many of a kind."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set[str]] = {k: set() for k in BASE}

        def cut() -> None:
            for k, v in held.items():
                held[k] = set(heapq.nsmallest(sample, v, key=lambda x: (_rank(x), x)))

        for b in batches:
            for t in b.column("text"):
                for _, k, _, v in base_spans(t.as_py() or ""):
                    if len(v) <= LONGEST:
                        held[k].add(v)
            if max(map(len, held.values())) > 20 * sample:
                cut()
        cut()
        rows = [(k, v, _rank(v)) for k, vs in held.items() for v in sorted(vs)]
        if rows:
            kind, value, rank = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.string()), "value": pa.array(value, pa.string()), "rank": pa.array(rank, pa.int64())})

    found = stored(docs.select(F.col(text).alias("text")).mapInArrow(find, "kind string, value string, rank long").distinct())
    out: list[tuple[str, str]] = []
    for kind in BASE:
        rows = found.where(F.col("kind") == kind).orderBy("rank", "value").limit(sample).collect()
        out += [(kind, r["value"]) for r in rows]
    return out


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, automata: dict[str, Automaton], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, counts of the base kinds, base_sha256 and spans of every row; no shuffle."""
    schema = docs.select(*keep).schema
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    held, read = docs.sparkSession.sparkContext.broadcast(automata), free("text", schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [spans_in(t.as_py() or "", held.value) for t in b.column(read)]
            count = [[sum(k == kind for _, k, _ in base) for base, _ in got] for kind in BASE]
            shas = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in got]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in count), pa.array(shas, pa.string()), pa.array([_joined(s) for _, s in got], pa.string())], names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(*keep, F.col(text).alias(read)).mapInArrow(run, schema)


def redacted(docs: DataFrame, automata: dict[str, Automaton], mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span, of base kinds or learned ones, replaced by a mark; n_chars, where
    there is such a column, follows. Documents stay, as do all other columns."""
    held = docs.sparkSession.sparkContext.broadcast(automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            changed: dict[int, str] = {}
            for i, x in enumerate(b.column("text")):
                t = x.as_py() or ""
                _, spans = spans_in(t, held.value)
                if not spans:
                    continue
                parts, done = [], 0
                for s, _, e in spans:
                    if s >= done:
                        parts += [t[done:s], mark]
                    done = max(done, e)
                changed[i] = "".join(parts) + t[done:]
            if changed:
                for name, new in (("text", lambda t: t), ("n_chars", len)):
                    if name in b.schema.names:
                        k = b.schema.get_field_index(name)
                        values = b.column(k).to_pylist()
                        for i, t in changed.items():
                            values[i] = new(t)
                        b = b.set_column(k, b.schema.field(k), pa.array(values, b.schema.field(k).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


@lru_cache(maxsize=1)
def _published() -> tuple:
    return tuple(sorted(learned(examples()).items()))


def trained(docs: DataFrame, sample: int = SAMPLE, more: list[tuple[str, str]] = ()) -> dict[str, Automaton]:
    """Automata of the corpus's labelled credentials, of ``more`` (kind, credential), and of the published formats."""
    return dict(_published()) | learned([*credentials(docs, sample), *more])


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan(docs, trained(docs))
