"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from riskloom.llm import conversation as C

INK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired): uniform-cost search with (cost, letters) as the key."""
    todo = [(0, "", 0, "", ())]
    seen = set()
    while True:
        cost, audit, k, roles, out = heapq.heappop(todo)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(out)
        state = (k, roles[-1:], cost, audit)
        if state in seen:
            continue
        seen.add(state)

        def legal(r):
            return re.fullmatch("s?(ua)*u?", roles + r) and roles + r != ""
        if audit[-3:] != "III":
            for role in ("user", "assistant"):
                if legal(role[0]):
                    heapq.heappush(todo, (cost + 2, audit + "I", k, roles + role[0], out + ((role, ""),)))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(todo, (cost + 3, audit + "D", k + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role and legal(role[0]):
                    heapq.heappush(todo, (cost + more, audit + "K", k + 1, roles + role[0], out + ((role, text),)))
                for new in ("user", "assistant"):
                    if legal(new[0]):
                        heapq.heappush(todo, (cost + 2 + more, audit + "R", k + 1, roles + new[0], out + ((new, text),)))


def brute(table, search=True):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        rows += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faulty, seen = [], set()
        for _, role, text in rows:
            ink = INK.findall(text)
            faulty.append((role, text, "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        firsts = [r[:1] for _, r, _ in rows]
        cost, audit, fixed = cheapest(faulty)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(5)
    out = []
    for conv in range(70):
        for turn in range(rnd.randrange(1, 9)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            out.append((conv, rnd.choice([turn, turn, turn * 2, None]), role, rnd.choice(["Yes.", "No!", "no end", " ", "", "é\U0001f600?", "Yes.", None])))
    out += [(None, 1, "user", "Hi."), (None, None, None, None), (200, None, "user", "A."), (200, None, "assistant", "B.")]
    return out + out[:20]


@pytest.fixture(scope="module")
def frame(spark, table):
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, audit string, there int").repartition(5)
    return df


def test_repair(spark, table, frame):
    want = brute(table)
    assert got(C.digest(spark, frame)) == want
    assert any("I" in r[7] for r in want) and any("R" in r[7] for r in want) and any("D" in r[7] for r in want)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_long_conversations_by_blocks(spark, table, frame, block):
    damaged = C.damaged(frame)
    assert got(C.repair(spark, damaged, long=2, block=block)) == brute(table)


def test_blocks_equal_one_pass(spark):
    rnd = random.Random(6)
    rows = [(1, k, rnd.choice(["user", "assistant", "user", "tool"]), rnd.choice(["Yes.", "no", f"{k}.", f"{k}!"])) for k in range(1500)]
    df = C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got(C.repair(spark, df)) == got(C.repair(spark, df, long=10, block=64))


def test_repaired_rows_are_legal(spark, frame):
    for r in C.repair(spark, C.damaged(frame)).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in r.repaired))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in r.repaired).encode()).hexdigest()


def test_weights_order_as_cost_then_letters():
    ws = C.Weights(6)
    made = {}
    for audit in ("", "K", "KI", "KK", "D", "IKD", "RRRRRR"):
        for cost in (0, 2, 7):
            made[cost, audit] = ws.before(C._number(audit), len(audit), cost, 0)
    assert sorted(made, key=made.get) == sorted(made)
    assert all((ws.cost(w), ws.audit(w)) == k for k, w in made.items())


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert got(C.digest(spark, df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.digest(spark, df.limit(0)).collect() == []


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert got(C.digest(spark, df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
