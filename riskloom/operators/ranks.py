"""Distributed ordered statistics: exact quantiles by radix selection, hashed cut-offs.

A running sum over a global order is the one shape Spark cannot run without
care: ``Window.orderBy`` with no partition puts every row into one task. Nothing
here orders rows: values and hashes are counted by their upper bits, and only
the counts in which a wanted place lies are looked at more closely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import checkpointed, stored

#: Upper bits of the 60-bit hash that rows are counted by, in two steps of half as many.
CUT_BITS = 20
#: Bits of a digit of radix selection.
DIGIT_BITS = 16


def _cut_prefixes(df: DataFrame, hk: Column, quota, g: list[str]) -> DataFrame:
    """Per group: ``_all`` (quota >= size), or the prefix in which the quota ends and how many rows of it are in.

    One pass counts by prefix; a group has at most 2^20 of these counts. They
    are summed by their upper half, and only the counts of the one upper half
    where the quota ends are looked at one by one.
    """
    prefix = F.shiftrightunsigned(hk, 60 - CUT_BITS)
    counts = df.groupBy(*g, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_cnt"))
    tops = counts.groupBy(*g, F.shiftrightunsigned("_p", CUT_BITS // 2).alias("_top")) \
        .agg(F.sum("_cnt").alias("_n"), F.sort_array(F.collect_list(F.struct("_p", "_cnt"))).alias("_low"))
    upto = F.sum("_n").over(Window.partitionBy(*g).orderBy("_top"))
    summed = tops.withColumn("_upto", upto).withColumn("_size", F.sum("_n").over(Window.partitionBy(*g))).withColumn("_need", quota(F.col("_size")))
    hit = (F.col("_need") < F.col("_size")) & (F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need"))
    # groups that are in whole, or not at all, keep their first row without a prefix
    edge = ((F.col("_need") >= F.col("_size")) | (F.col("_need") <= 0)) & (F.col("_upto") == F.col("_n"))
    start = F.struct(F.lit(None).cast("bigint").alias("p"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("left"))
    found = F.aggregate("_low", start, lambda a, x: F.when(a["p"].isNotNull(), a).when(x["_cnt"] >= a["left"], F.struct(x["_p"].alias("p"), a["left"].alias("left")))
                        .otherwise(F.struct(F.lit(None).cast("bigint").alias("p"), (a["left"] - x["_cnt"]).alias("left"))))
    return summed.filter(hit | edge).select(*g, (F.col("_need") >= F.col("_size")).alias("_all"), F.when(hit, found).alias("_f")) \
        .select(*g, "_all", F.col("_f.p").alias("_prefix"), F.col("_f.left").alias("_left"))


def hash_cutoffs(df: DataFrame, order_cols: list[str], quota, group_cols: list[str]) -> DataFrame:
    """Per group (NULL is a group), where its quota of rows in hash order ends.

    The first order column is a 60-bit hash. One pass finds the prefix of 20
    bits in which the quota ends, a second one ranks that prefix's distinct
    keys (about rows / 2^20 a group; a repeated key is one, however often it
    occurs). ``quota`` maps the group size (a column) to the number of rows. One
    row a group, kept in the shared folder: the group columns as ``_g_<c>``,
    ``_all`` (quota >= size), the order columns of the last row as ``_c_<c>``,
    and ``_ties``: how many of the rows equal to it in all order columns are
    inside (NULL: all of them). Rows without a hash do not count.
    """
    hk = F.col(order_cols[0])
    g = [f"_g_{c}" for c in group_cols]
    rows = df.filter(hk.isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(group_cols, g)], *order_cols)
    cut = stored(_cut_prefixes(rows, hk, quota, g))
    inside = _join_groups(rows, cut.filter(F.col("_prefix").isNotNull()), g).filter(F.shiftrightunsigned(hk, 60 - CUT_BITS) == F.col("_prefix"))
    keys = inside.groupBy(*g, *order_cols).agg(F.count(F.lit(1)).alias("_cnt"), F.first("_left").alias("_left"))
    keys = keys.withColumn("_upto", F.sum("_cnt").over(Window.partitionBy(*g).orderBy(*order_cols)))
    last = keys.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_cnt") < F.col("_left")))
    ties = F.col("_left") - F.col("_upto") + F.col("_cnt")
    last = last.select(*[F.col(n).alias(f"_l{n}") for n in g], *[F.col(c).alias(f"_c_{c}") for c in order_cols], F.when(ties < F.col("_cnt"), ties).alias("_ties"))
    out = cut.drop("_prefix", "_left").join(last, [F.col(n).eqNullSafe(F.col(f"_l{n}")) for n in g] or F.lit(True), "left")
    return stored(out.drop(*[f"_l{n}" for n in g]))


def _join_groups(a: DataFrame, b: DataFrame, g: list[str]) -> DataFrame:
    """Inner join on the group columns, NULL equal to NULL; without groups ``b`` is one row."""
    right = b.select(*[F.col(n).alias(f"_r{n}") for n in g], *[c for c in b.columns if c not in g])
    on = [F.col(n).eqNullSafe(F.col(f"_r{n}")) for n in g] or F.lit(True)
    return a.join(right, on).drop(*[f"_r{n}" for n in g])


def flag_first_n(df: DataFrame, order_cols: list[str], quota, group_cols: list[str] | None = None,
                 name: str = "_first_n") -> DataFrame:
    """Flag (1/0) the first ``quota`` rows per group in (order_cols) order.

    Rows up to a group's cut-off are in by a plain comparison. Only if the
    cut-off falls inside a repeated key are the rows with that key numbered, by
    the part they are kept in, so that many of them are no single task. NULL is a
    group like any other.
    """
    g = list(group_cols or [])
    cut = hash_cutoffs(df, order_cols, quota, g)
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in g] or F.lit(True)
    joined = df.join(cut, on, "left")
    equal, before = F.lit(True), F.lit(False)
    for c in order_cols:
        before = before | (equal & (F.col(c) < F.col(f"_c_{c}")))
        equal = equal & (F.col(c) == F.col(f"_c_{c}"))
    whole = F.coalesce(F.col("_all"), F.lit(False))
    inside = whole & F.col(order_cols[0]).isNotNull() | F.coalesce(before | equal, F.lit(False))
    parted = cut.filter(F.col("_ties").isNotNull())
    if parted.isEmpty():
        return joined.select(*[F.col(c) for c in df.columns], inside.cast("int").alias(name))
    tied = F.coalesce(equal & F.col("_ties").isNotNull(), F.lit(False))
    plain = joined.filter(~tied).select(*[F.col(c) for c in df.columns], inside.cast("int").alias(name))
    kept = checkpointed(joined.filter(tied).select(*[F.col(c) for c in df.columns], "_ties", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    same = list(dict.fromkeys([*g, *order_cols]))
    sizes = kept.groupBy(*same, "_part").agg(F.count(F.lit(1)).alias("_cnt"))
    skip = F.coalesce(F.sum("_cnt").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    skips = sizes.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_s_{c}") for c in same], skip.alias("_skip"))
    turn = F.row_number().over(Window.partitionBy(*same, "_part").orderBy("_at"))
    numbered = kept.withColumn("_turn", turn).join(skips, [F.col("_part") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in same]])
    return plain.unionByName(numbered.select(*[F.col(c) for c in df.columns], (F.col("_skip") + F.col("_turn") <= F.col("_ties")).cast("int").alias(name)))


def _ordered(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles (-0.0 is 0.0)."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def _double(key: int) -> float:
    k = np.array([key], np.int64)
    return float((k ^ ((k >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _digit_counts(df: DataFrame, cols: list[str], level: int, targets: dict[int, list[int]]) -> list:
    """Rows (v, t, d, n, low, high): how many keys of column v that begin with the digits t have d as the next one, and the least and largest of them.

    Digits are 16 bits, so a task holds 65,536 counts a target. At the first
    level the missing values of a column are its digit None.
    """
    up, down = np.int64(64 - DIGIT_BITS * level), np.int64(64 - DIGIT_BITS * (level + 1))
    size, low_end, high_end = 1 << DIGIT_BITS, np.iinfo(np.int64).max, np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(v, t): (np.zeros(size, np.int64), np.full(size, low_end), np.full(size, high_end)) for v, ts in targets.items() for t in ts}
        missing = dict.fromkeys(targets, 0)
        for batch in batches:
            for v, ts in targets.items():
                values = np.asarray(batch.column(v).to_numpy(zero_copy_only=False), dtype="float64")
                known = values[~np.isnan(values)]
                missing[v] += len(values) - len(known)
                keys = np.sort(_ordered(known))
                for t in ts:
                    own = keys if level == 0 else keys[np.searchsorted(keys >> up, t):np.searchsorted(keys >> up, t, side="right")]
                    if len(own):
                        digit = (own >> down) & np.int64(size - 1)
                        first = np.flatnonzero(np.diff(own >> down, prepend=(own[0] >> down) - 1))
                        last = np.append(first[1:], len(own))
                        d = digit[first]
                        n, low, high = held[v, t]
                        n[d] += last - first
                        low[d] = np.minimum(low[d], own[first])
                        high[d] = np.maximum(high[d], own[last - 1])
        for (v, t), (n, low, high) in held.items():
            d = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), v, np.int32)), pa.array(np.full(len(d), t)), pa.array(d.astype(np.int32)), pa.array(n[d]), pa.array(low[d]), pa.array(high[d])], names=names)
        if level == 0:
            at = list(missing)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([0] * len(at), pa.int64()), pa.array([None] * len(at), pa.int32()),
                                              pa.array([missing[v] for v in at], pa.int64()), pa.array([0] * len(at), pa.int64()), pa.array([0] * len(at), pa.int64())], names=names)

    names = ["v", "t", "d", "n", "low", "high"]
    made = df.select(*cols).mapInArrow(run, "v int, t long, d int, n long, low long, high long")
    return made.groupBy("v", "t", "d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # at most 65,536 a target


def order_statistics(df: DataFrame, cols: list[str], ranks) -> tuple[list[int], list[dict[int, float]], list[int]]:
    """By radix selection: the size of each column, its values at the ranks (from 0) that ``ranks(size)`` asks for, and its missing values.

    A pass counts by the next 16 bits of the values' order-preserving key, and
    only the digits in which a rank ends are looked at again: at most four
    passes, one if the values there are equal already. No value is shuffled.
    """
    numeric = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).persist(StorageLevel.MEMORY_AND_DISK)
    names = [f"_{i}" for i in range(len(cols))]
    sizes, missing, found = [0] * len(cols), [0] * len(cols), [{} for _ in cols]
    try:
        # (column, digits so far) -> the ranks asked for, with the rank inside
        todo: dict[tuple[int, int], list[tuple[int, int]]] = {(v, 0): [] for v in range(len(cols))}
        for level in range(64 // DIGIT_BITS):
            targets: dict[int, list[int]] = {}
            for v, t in todo:
                targets.setdefault(v, []).append(t)
            bins: dict[tuple[int, int], list] = {}
            for r in _digit_counts(numeric, names, level, targets):
                if r["d"] is None:
                    missing[r["v"]] = r["n"]
                else:
                    bins.setdefault((r["v"], r["t"]), []).append(r)
            rest: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for (v, t), asked in todo.items():
                # the least key tells the order of the digits, whose first one has a sign
                rows = sorted(bins.get((v, t), []), key=lambda r: r["low"])
                if level == 0:
                    sizes[v] = sum(r["n"] for r in rows)
                    asked = [(k, k) for k in sorted(set(ranks(sizes[v])))] if sizes[v] else []
                for rank, inside in asked:
                    for r in rows:
                        if inside < r["n"]:
                            break
                        inside -= r["n"]
                    if r["low"] == r["high"]:
                        found[v][rank] = _double(r["low"])
                    else:
                        rest.setdefault((v, r["low"] >> (64 - DIGIT_BITS * (level + 1))), []).append((rank, inside))
            todo = rest
            if not todo:
                break
    finally:
        numeric.unpersist()
    return sizes, found, missing


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], missing: dict | None = None, sizes: dict | None = None) -> dict[str, list[float | None]]:
    """Driver-side dict {column: [quantile per prob]} (pandas / ``quantile_cont`` rule); None for all-missing columns.

    ``missing`` and ``sizes`` (if given) receive the NULL/NaN and the other counts from the same passes.
    """
    places = lambda n: [k for p in probs for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]
    counts, found, gone = order_statistics(df, cols, places)
    if missing is not None:
        missing.update(zip(cols, gone))
    if sizes is not None:
        sizes.update(zip(cols, counts))

    def at(v: int, p: float) -> float | None:
        if not counts[v]:
            return None
        h = (counts[v] - 1) * p
        low, high = found[v][math.floor(h)], found[v][math.ceil(h)]
        return low + (h - math.floor(h)) * (high - low)

    return {c: [at(v, p) for p in probs] for v, c in enumerate(cols)}


def quantiles_frame(df: DataFrame, cols: list[str], probs: list[float], names: list[str] | None = None) -> DataFrame:
    """Exact quantiles as one row per variable that has a value: ``variable, n, <name_i>...``."""
    sizes: dict[str, int] = {}
    got = exact_quantiles(df, cols, probs, sizes=sizes)
    names = names or [f"q{i}" for i in range(len(probs))]
    rows = [(c, sizes[c], *got[c]) for c in cols if sizes[c]]
    return df.sparkSession.createDataFrame(rows, "variable string, n bigint, " + ", ".join(f"`{n}` double" for n in names))


def hashed_order_key(seed: int, key: Column) -> tuple[Column, Column]:
    """(numeric prefix, full md5) of ``"<seed>:<key>"``: a reproducible random order
    that any engine with md5 can repeat."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), h


def ceil_share(n: Column, share: float) -> Column:
    """ceil(share * n) in exact integer arithmetic for shares with <= 6 decimals."""
    scale = 10 ** 6
    num = int(round(share * scale))
    return F.floor((n * F.lit(num) + F.lit(scale - 1)) / F.lit(scale)).cast("bigint")
