"""Spelling variants against all pairs compared in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from riskloom.llm import spelling


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    k = 0
    while k < len(x) and x[k] == y[k]:
        k += 1
    return x[k + 1:] == y[k + 1:] if len(x) == len(y) else x[k:] == y[k + 1:]


def brute(rows):
    n = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[:h % len(r)] + r[h % len(r) + 1:] if h % 31 == 0 else r] += 1
    v = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    form, count = {}, {}
    for w in v:
        others = [x for x in v if near(w, x)]
        best = min(others, key=lambda x: (-v[x], x), default=None)
        form[w], count[w] = best if best is not None and v[best] >= 10 * v[w] else None, len(others)
    out = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, v[w], count[w], v[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """Many near words over three letters, runs of one letter, words on both sides of the acceptor's limit, nulls, repeated rows."""
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(7, 11))) for _ in range(250)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "x" * 30 + "y" + "x" * 34]
    out = [(i, " ".join(rnd.choices(base, weights=[1000 / (k + 1) for k in range(len(base))], k=200)).replace("é", "É" if i % 3 == 0 else "é")) for i in range(40)]
    edge = (7, " ".join(["x" * n for n in (63, 64, 65, 66)] + ["z" * 5000, "z" * 5001]))
    return [*out, edge, edge, (None, None), (None, ""), (None, "Éabcdef × Éabcdef÷")]


@pytest.mark.parametrize("limit", [spelling.BLOCK_WORDS, 100, 5])
def test_variants(spark, rows, limit):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, word int, root string")
    found = spelling.variants(spark, df, limit=limit).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute(rows)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert any(r[1] for r in want) and any(len(r[0]) > 64 and r[4] for r in want)


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("x", "y", "xy") for b in ("ing", "ed", "s"))
    machine = spelling.Acceptor(words)
    assert sorted(machine.common(machine.start, machine.start)) == words
    rights = [tuple(sorted(machine.common(s, s))) for s in range(len(machine.final))]
    assert len(set(rights)) == len(rights)
    assert sorted(tuple(sorted(p)) for p in machine.near()) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_chain_of_forms(spark):
    df = spark.createDataFrame([(1, " ".join(["colours"] * 300 + ["coloars"] * 30 + ["coloara"] * 3 + ["farther"] * 2))], "doc_id long, text string")
    got = {r.word: r.root for r in spelling.variants(spark, df, damage=1 << 40).collect()}
    assert got == {"colours": "colours", "coloars": "colours", "coloara": "colours", "farther": "farther"}


def test_empty_table(spark):
    assert spelling.digest(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
