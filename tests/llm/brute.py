"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {i: i + 32 for i in range(65, 91)}
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def byte_dedup(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=key)


def window_dedup(rows, window):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out, key=key)


def quality_base(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        seen = Counter(grams)
        repeat = len({j for k, g in enumerate(grams) if seen[g] > 1 for j in range(k, k + 5)})
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)))
    return sorted(out, key=key)


def top_k(rows, k=10):
    rows = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in rows:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def shingle_set(text, size=5):
    w = WORD.findall((text or "").translate(AZ))
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def near(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    found = groups(ids, links)
    return sorted((i, len(sets[i]), found[i], found[i] == i) for i in ids)


def secret_spans(rows):
    out = []
    for i, t in rows:
        t = t or ""
        r = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
        r += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
        r += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 16]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(r))
        out.append((i, *(sum(x[1] == k for x in r) for k in range(3)), sha(text.encode())))
    return sorted(out, key=key)


def line_dedup(rows, percent=80):
    """(doc_id, removed line numbers); ids are distinct."""
    lines = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    by = defaultdict(list)
    for i, k, x in lines:
        by[x].append((i, k))
    texts = sorted(by)
    sets = {x: {x[k:k + 5] for k in range(len(x) - 4)} or {x} for x in texts}
    links = []
    for n, a in enumerate(texts):
        for b in texts[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    found = groups(texts, links)
    stays = {}
    for x in texts:
        stays[found[x]] = min(stays.get(found[x], by[x][0]), min(by[x]))
    gone = defaultdict(list)
    for i, k, x in lines:
        if (i, k) != stays[found[x]]:
            gone[i].append(k)
    return sorted((i, len((t or "").split("\n")), sorted(gone[i])) for i, t in rows)


def packed_ids(tokenizer, rows):
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows}


def crc(b):
    return zlib.crc32(b)
