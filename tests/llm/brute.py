"""Plain Python versions of the operators, to compare with on small tables. Rows are dicts."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def components(rows):
    sets = []
    for r in rows:
        w = SPACE_WORD.findall(lower(r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = Counter()
    for ids in holders.values():
        for j, b in enumerate(ids):
            for a in ids[:j]:
                shared[a, b] += 1
    for (a, b), o in shared.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r["doc_id"])
    return [(r["doc_id"], len(sets[i]), min((d for d in groups[root(i)] if d is not None), default=None)) for i, r in enumerate(rows)]


def without_copies(rows):
    """(doc_id, text) of the rows that stay: of a component the first by doc_id, those without one last; rows without words all."""
    sets = components(rows)
    best = {}
    out = []
    labels = labelled(rows)
    for r, (_, n, _), label in zip(rows, sets, labels, strict=True):
        if not n:
            out.append((r["doc_id"], r["text"]))
        elif label not in best or (r["doc_id"] is None, r["doc_id"] or 0) < (best[label][0] is None, best[label][0] or 0):
            best[label] = (r["doc_id"], r["text"])
    return out + list(best.values())


def labelled(rows):
    """A label of each row's component: the components of the same rows, numbered."""
    return [c for _, _, c in components([{"doc_id": i, "text": r["text"]} for i, r in enumerate(rows)])]


def rule_features(r):
    t = r["text"] or ""
    w = SPACE_WORD.findall(t)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
    base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), base


BASE_SECRETS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(t):
    found = [(m.start(), k, m.end()) for k, (p, ok) in BASE_SECRETS.items() for m in p.finditer(t) if ok(m)]
    order = list(BASE_SECRETS)
    return sorted(found, key=lambda x: (x[0], order.index(x[1])))


def base_secrets(r):
    found = base_spans(r["text"] or "")
    n = Counter(k for _, k, _ in found)
    return r["doc_id"], n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, k, e in found))


def contamination(rows, items, n=10):
    windows = defaultdict(set)
    for i in items:
        w = ALNUM_WORD.findall(lower(i["text"]))
        for k in range(max(0, len(w) - n) + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i["item_id"]))
    sizes = sorted({len(w) for w in windows})
    out = []
    for r in rows:
        w, hit, got = ALNUM_WORD.findall(lower(r["text"])), set(), set()
        for k in range(len(w)):
            for z in sizes:
                if k + z <= len(w) and (x := tuple(w[k : k + z])) in windows:
                    hit |= set(range(k, k + z))
                    got |= windows[x]
        out.append((r["doc_id"], len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit)))
    return out


def substring(rows, n=50):
    first = {}
    split = [SPACE_WORD.findall(r["text"] or "") for r in rows]
    for r, w in zip(rows, split, strict=True):
        for k in range(len(w) - n + 1 if r["doc_id"] is not None else 0):
            x = tuple(w[k : k + n])
            first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - n + 1 if r["doc_id"] is not None else 0):
            if first[tuple(w[k : k + n])] < r["doc_id"]:
                gone |= set(range(k, k + n))
        out.append((r["doc_id"], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def targets(size):
    """Targets of {source: words}, by repeated shares in exact arithmetic."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, fixed = list(order), {}
    while open_:
        level = Fraction(sum(size.values()) - sum(fixed.values())) / sum(weight[s] for s in open_)
        full = {s: 3 * size[s] for s in open_ if level * weight[s] > 3 * size[s]}
        if not full:
            return {s: float(fixed[s] if s in fixed else level * weight[s]) for s in order}
        fixed |= full
        open_ = [s for s in open_ if s not in full]
    return {s: float(fixed[s]) for s in order}
