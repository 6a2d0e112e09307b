"""Conversation structure repair: cheapest edits by one integer-minimum DP.

A conversation is legal if its role initials are ``(s?(ua)+)?``. The edits Keep,
Rerole, Delete and Insert move through a DAG of (row, state of that pattern). A
path's weight is one big integer: the high digits carry its cost, and below them
stands a field of fixed width with one digit an edit, the first edit's highest
and zeros after the last. So the smaller integer is the cheaper path and, at
equal cost, the one whose letters D < I < K < R come first, and a plain minimum
decides everything. Seen from the end, an edit puts its digit before those of the
rest: a shift by one digit, which keeps the order.

Conversations of at most ``LONG`` rows are dealt by id, sorted, and streamed
through one DP each. A longer one is cut into blocks of its sorted rows; every
block yields the best weight between each two states, and these are joined from
the last block to the first by the same arithmetic, so no task holds its rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.linking import saved

#: Rows of a conversation that one DP takes at most; rows of a block of a longer one; conversations whose ids may be broadcast.
LONG, BLOCK, FEW = 4096, 1024, 100_000
#: Bits of a digit, and the digits of the letters in their ASCII order.
BITS, DIGIT = 3, {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {d: c for c, d in DIGIT.items()}
#: States of the pattern: nothing yet, after s, after u, after a. Next state by role initial, and the one role that may be put in.
START, S, U, A = range(4)
NEXT = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
PUT = (("user", U), ("user", U), ("assistant", A), ("user", U))
#: Faults of a row.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_INK = re.compile(r"[^\x20\x09-\x0D]")

_RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired array<struct<role:string,text:string>>, repaired_sha256 string")
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


class Weights:
    """Path weights with a field of ``digits`` digits below the cost."""

    def __init__(self, digits: int):
        self.width = BITS * digits

    def before(self, letters: int, n: int, cost: int, rest: int) -> int:
        """The weight of ``n`` edits (their digits, their cost) followed by ``rest``."""
        high, low = rest >> self.width, rest & (1 << self.width) - 1
        return (high + cost << self.width) | letters << self.width - BITS * n | low >> BITS * n

    def cost(self, weight: int) -> int:
        return weight >> self.width

    def audit(self, weight: int) -> str:
        out, at = [], self.width
        while at and (d := weight >> (at := at - BITS) & 7):
            out.append(LETTER[d])
        return "".join(out)


def _least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def _with_inserts(ws: Weights, best: list[int | None]) -> list[int | None]:
    """Any number of rows put in before what ``best`` goes on from; more than two only come back to a state."""
    def put(rest):
        return None if rest is None else ws.before(DIGIT["I"], 1, 2, rest)
    once = [put(best[PUT[q][1]]) for q in range(4)]
    twice = [put(once[PUT[q][1]]) for q in range(4)]
    return [_least(*c) for c in zip(best, once, twice)]


def _backward(ws: Weights, rows: list[tuple[str, int]], best: list[int | None]) -> list[int | None]:
    """Least weights from each state before the rows (initial, fault), given those after them."""
    for initial, fault in reversed(rows):
        now = []
        for q in range(4):
            ways = [None if best[q] is None else ws.before(DIGIT["D"], 1, 3, best[q])]
            if fault in (FINE, TRUNCATED):
                extra = int(fault == TRUNCATED)
                to = NEXT[q].get(initial)
                if to is not None and best[to] is not None:
                    ways.append(ws.before(DIGIT["K"], 1, extra, best[to]))
                if best[PUT[q][1]] is not None:
                    ways.append(ws.before(DIGIT["R"], 1, 2 + extra, best[PUT[q][1]]))
            now.append(_least(*ways))
        best = _with_inserts(ws, now)
    return best


def digits_for(n: int) -> int:
    """Letters of n rows at most: one each, and two rows put in at each of the n + 1 places."""
    return n + 2 * (n + 1)


def _ended(ws: Weights) -> list[int | None]:
    """Weights of the empty rest: legal with nothing yet or after an assistant."""
    return _with_inserts(ws, [0, None, None, 0])


def edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the best repair of rows (initial, fault)."""
    ws = Weights(digits_for(len(rows)))
    best = _backward(ws, rows, _ended(ws))[START]
    return ws.cost(best), ws.audit(best)


def apply(audit: str, rows: Iterator[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """The repaired rows (role, text); the audit letters decide them, since each state takes one put-in role."""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = NEXT[state][role[0]]
        else:
            role, state = PUT[state]
        yield role, text


def fault(role: str, text: str, seen: set) -> int:
    """The first fault of a row; ``seen`` holds digests of the roles and texts before it."""
    ink = _INK.findall(text)
    key = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()[:16]
    again = key in seen
    seen.add(key)
    return BLANK if not ink else DUPLICATE if again else TRUNCATED if ink[-1] not in ".!?" else FINE


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _solve(conv_id: int | None, rows: list[tuple]) -> dict:
    """The result of one conversation; rows (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    seen: set = set()
    faults = [fault(role, text, seen) for _, role, text in rows]
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = edits(list(zip(initials, faults)))
    repaired = list(apply(audit, iter([(role, text) for _, role, text in rows])))
    return {"conv_id": conv_id, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE),
            "truncated": faults.count(TRUNCATED), "illegal": _illegal(initials), "cost": cost, "audit": audit,
            "repaired": [{"role": r, "text": t} for r, t in repaired], "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()}


_RESULT_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                           ("audit", pa.string()), ("repaired", _ROWS), ("repaired_sha256", pa.string())])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole conversations in, one row a conversation out; a conversation may go on in the next batch."""
    current, rows, started = None, [], False
    for batch in batches:
        out = []
        for conv_id, turn, role, text, there in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there"))):
            if not started or conv_id != current:
                if started:
                    out.append(_solve(current, rows))
                current, rows, started = conv_id, [], True
            if there:
                rows.append((turn, role, text))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RESULT_ARROW)
    if started:
        yield pa.RecordBatch.from_pylist([_solve(current, rows)], schema=_RESULT_ARROW)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): a twentieth of the rows each is dropped (there is false), emptied, loses its ``[.!?]``, is doubled or becomes a user's.

    By crc32 of ``conv_id:turn``; null roles and texts, and nulls in that key, are one space.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    d, text = F.crc32(key) % 20, F.coalesce("text", space)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(d == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (d != 0).alias("there"), F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _matrices(table: pa.Table) -> pa.Table:
    """Per conversation of a block: the best edits between each two states, and the roles at its ends."""
    out, rows = {}, {}
    for at, conv_id, initial, fault_, block in sorted(zip(*(table.column(c).to_pylist() for c in ("at", "conv_id", "initial", "fault", "block"))), key=lambda r: r[0]):
        rows.setdefault(conv_id, []).append((initial, fault_))
        out[conv_id] = block
    made = []
    for conv_id, part in rows.items():
        ws = Weights(digits_for(len(part)))
        ways = []
        for last in range(4):
            first = _backward(ws, part, [0 if q == last else None for q in range(4)])
            ways += [{"first": q, "last": last, "cost": ws.cost(w), "audit": ws.audit(w)} for q, w in enumerate(first) if w is not None]
        made.append({"conv_id": conv_id, "block": out[conv_id], "n": len(part), "illegal": _illegal([i for i, _ in part]), "ends": part[0][0] + "\n" + part[-1][0], "ways": ways})
    return pa.Table.from_pylist(made, schema=_MATRIX_ARROW)


_WAYS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_MATRIX_ARROW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("illegal", pa.int64()), ("ends", pa.string()), ("ways", _WAYS)])
_MATRIX = "conv_id long, block long, n long, illegal long, ends string, ways array<struct<first:int,last:int,cost:long,audit:string>>"


def _number(audit: str) -> int:
    """The letters as digits, the first highest (an octal number)."""
    return int("".join(str(DIGIT[c]) for c in audit) or "0", 8)


def _joined(table: pa.Table) -> pa.Table:
    """One conversation's blocks from the last to the first: its cost, and each block's part of the audit with the state it begins in."""
    blocks = sorted(table.to_pylist(), key=lambda b: b["block"])
    ws = Weights(digits_for(sum(b["n"] for b in blocks)))
    best, after = _ended(ws), []
    for b in reversed(blocks):
        now, chosen = [None] * 4, [None] * 4
        for w in b["ways"]:
            if best[w["last"]] is not None:
                weight = ws.before(_number(w["audit"]), len(w["audit"]), w["cost"], best[w["last"]])
                if now[w["first"]] is None or weight < now[w["first"]]:
                    now[w["first"]], chosen[w["first"]] = weight, w
        best = now
        after.append(chosen)
    illegal, state, out, audit = sum(b["illegal"] for b in blocks), START, [], ws.audit(best[START])
    for a, b in zip(blocks, blocks[1:]):
        pair = a["ends"].split("\n")[1] + b["ends"].split("\n")[0]
        illegal += pair not in ("su", "ua", "au")
    at = 0
    for k, (b, chosen) in enumerate(zip(blocks, reversed(after))):
        w = chosen[state]
        end = len(audit) if k + 1 == len(blocks) else at + len(w["audit"])
        out.append({"conv_id": b["conv_id"], "block": b["block"], "state": state, "part": audit[at:end], "cost": ws.cost(best[START]), "illegal": illegal})
        state, at = w["last"], end
    return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("state", pa.int32()), ("part", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())]))


def _pieces(rows: pa.Table, parts: pa.Table) -> pa.Table:
    """The repaired text of each conversation's part of a block."""
    of: dict = {}
    for r in sorted(rows.select(["at", "conv_id", "role", "text"]).to_pylist(), key=lambda r: r["at"]):
        of.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    out = []
    for p in parts.to_pylist():
        lines = [f"{r}:{t}" for r, t in apply(p["part"], iter(of[p["conv_id"]]), p["state"])]
        out.append({"conv_id": p["conv_id"], "block": p["block"], "part": p["part"], "some": bool(lines), "piece": "\n".join(lines)})
    return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.string()), ("some", pa.bool_()), ("piece", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order in, one hash a conversation out; the text is streamed, only the audit is held."""
    current, sha, audit, some, started = None, hashlib.sha256(), [], False, False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for conv_id, part, has, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "some", "piece"))):
            if not started or conv_id != current:
                if started:
                    yield row()
                current, sha, audit, some, started = conv_id, hashlib.sha256(), [], False, True
            audit.append(part)
            if has:
                sha.update((b"\n" if some else b"") + piece.encode())
                some = True
    if started:
        yield row()


def _repair_long(spark: SparkSession, rows: DataFrame, block: int) -> DataFrame:
    """Conversations of any length: sorted once over all tasks, solved by blocks.

    Only the hash of the repaired text, which no one can compute in parts, is
    streamed by one task a conversation.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    # equal rows can be in any order, so a number keeps very many of them from being one key of the ranges
    ranged = rows.where("there").withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order, "spread").sortWithinPartitions(*order)
    # the number given to a sorted row when it is written is its place in the order of all
    placed = saved(spark, ranged.withColumn("at", F.monotonically_increasing_id()).drop("spread", "there"), "placed")
    placed = placed.withColumn("block", F.col("at") - F.pmod("at", F.lit(block)))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed = placed.select("conv_id", "at", key.alias("key"))
    again = keyed.groupBy("conv_id", "key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    repeats = saved(spark, keyed.join(saved(spark, again, "again"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where("at > first").select("at"), "repeats")
    ink = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    facts = placed.select("conv_id", "turn", "at", "block", F.substring("role", 1, 1).alias("initial"), ink.alias("ink")).join(repeats.withColumn("twice", F.lit(True)), "at", "left") \
        .select("conv_id", "turn", "at", "block", "initial",
                F.when(F.col("ink") == "", BLANK).when(F.col("twice"), DUPLICATE).when(~F.col("ink").isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("fault"))
    facts = saved(spark, facts, "facts")
    ways = saved(spark, facts.groupBy("block").applyInArrow(_matrices, _MATRIX), "ways")
    parts = saved(spark, ways.groupBy("conv_id").applyInArrow(_joined, "conv_id long, block long, state int, part string, cost long, illegal long"), "parts")
    pieces = placed.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(_pieces, "conv_id long, block long, part string, some boolean, piece string")
    hashes = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    counts = facts.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == k).alias(c) for c, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))]) \
        .groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
                                F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    totals = parts.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    names = rows.select("conv_id").distinct()

    def by_id(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnRenamed("conv_id", "_other")
        return left.join(other, F.col("conv_id").eqNullSafe(F.col("_other")), "left").drop("_other")

    out = by_id(by_id(by_id(names, counts), totals), hashes)
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.lit(None).cast("array<struct<role:string,text:string>>").alias("repaired"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair(spark: SparkSession, rows: DataFrame, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, there).

    Rows count where ``there`` is true; a conversation without such rows is
    empty. They are taken by turn (nulls first), equal turns by role and text.
    Returns conv_id (null is a conversation of its own), gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired (rows of role and text; null for
    conversations of more than ``long`` rows) and repaired_sha256. An audit is
    one value, so a conversation may have about 2^31 edits. An empty table gives
    no rows; other columns are not read.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "there")
    large = saved(spark, rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select(F.col("conv_id").alias("_large")), "large")
    n = large.count()
    some = F.broadcast(large) if n <= FEW else large
    same = F.col("conv_id").eqNullSafe(F.col("_large"))
    short = rows.join(some, same, "left_anti") if n else rows
    found = short.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(_short, _RESULT)
    return found.unionByName(_repair_long(spark, saved(spark, rows.join(some, same, "left_semi"), "long"), block)) if n else found


def digest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The conversations after damage, repaired, without the repaired rows."""
    return repair(spark, damaged(rows)).drop("repaired")
