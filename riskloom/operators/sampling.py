"""Reproducible hashed sampling, stratified splitting and bootstrap draws.

Draws are keyed by ``md5("<seed>:<row key>")``: stable under any partitioning
and repeatable by any SQL engine with md5. The hash is uniform, so its upper
bits are the buckets: rows are counted by prefix, and only the prefixes that
matter are looked at row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators.ranks import ceil_share, flag_first_n, hashed_order_key
from riskloom.session import stored


def with_hash(df: DataFrame, seed: int, key_col: str) -> DataFrame:
    """Adds ``_hk`` (the upper 60 bits of the row's hash) and ``_h`` (the whole of it), the order of all draws."""
    prefix, full = hashed_order_key(seed, F.col(key_col))
    return df.withColumn("_hk", prefix).withColumn("_h", full)


def sample_n(df: DataFrame, n: int, seed: int = 42, key_col: str = "row_key") -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, chosen by hashed key order.

    Of rows with one key as many as fit are taken; rows with a NULL key are never
    drawn, being without a place in the order.
    """
    h = with_hash(df.filter(F.col(key_col).isNotNull()), seed, key_col)
    flagged = flag_first_n(h, ["_hk", "_h", key_col], lambda _: F.lit(n).cast("bigint"), name="_keep")
    return flagged.filter(F.col("_keep") == 1).drop("_keep", "_hk", "_h")


def stratified_split(df: DataFrame, label_col: str, test_share: float = 0.30, seed: int = 42,
                     key_col: str | None = "row_key", flag_col: str = "is_test") -> DataFrame:
    """Flag the test rows: per class (NULL is one), the first ceil(share * class size) rows in hashed order.

    Without ``key_col`` the rows have their hash already (``with_hash``), so that many splits of one table share it.
    """
    h = with_hash(df, seed, key_col) if key_col else df
    flagged = flag_first_n(h, ["_hk", "_h", *([key_col] if key_col else [])], lambda size: ceil_share(size, test_share), group_cols=[label_col], name=flag_col)
    return flagged.drop("_hk", "_h")


def bootstrap_sample(spark: SparkSession, df: DataFrame, n_draws: int, seed: int = 42,
                     key_col: str = "row_key") -> DataFrame:
    """``n_draws`` rows with replacement (exact, reproducible).

    Rows are ordered by hashed key; draw ``j`` picks position
    ``md5("<seed>:draw:<j>") mod N``. Counts by 12 and by 24 upper bits of the
    hash say in which prefix a position lies; only rows of drawn prefixes are
    numbered, and the rows themselves (not their keys) are picked, so repeated
    keys are rows of their own.
    """
    h = with_hash(df, seed, key_col).withColumn("_p", F.shiftrightunsigned("_hk", 36))
    fine = stored(h.groupBy("_p").agg(F.count(F.lit(1)).alias("_cnt")).withColumn("_top", F.shiftrightunsigned("_p", 12)))
    tops = [(r["_top"], r["n"]) for r in fine.groupBy("_top").agg(F.sum("_cnt").alias("n")).orderBy("_top").collect()]  # at most 4,096
    n_rows = sum(n for _, n in tops)
    if n_rows == 0:
        return df.limit(0).withColumn("draw_id", F.lit(None).cast("bigint"))
    spans, at = [], 0
    for top, n in tops:
        spans.append((top, at, at + n))
        at += n
    coarse = F.broadcast(spark.createDataFrame(spans, "_top bigint, _start bigint, _end bigint"))  # at most 4,096 rows
    draw_key = F.concat(F.lit(f"{seed}:draw:"), F.col("id").cast("string"))
    pos = F.pmod(F.conv(F.substring(F.md5(draw_key), 1, 15), 16, 10).cast("bigint"), F.lit(n_rows))
    draws = spark.range(n_draws).select(F.col("id").alias("draw_id"), pos.alias("_pos")) \
        .join(coarse, (F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_end"))) \
        .select("draw_id", "_top", (F.col("_pos") - F.col("_start")).alias("_in_top"))
    upto = F.sum("_cnt").over(Window.partitionBy("_top").orderBy("_p"))
    spans = fine.select("_top", "_p", "_cnt", (upto - F.col("_cnt")).alias("_from"))
    drawn = draws.join(spans, "_top").filter((F.col("_from") <= F.col("_in_top")) & (F.col("_in_top") < F.col("_from") + F.col("_cnt"))) \
        .select("draw_id", "_p", (F.col("_in_top") - F.col("_from") + 1).alias("_rn"))
    drawn = stored(drawn)
    numbered = h.join(drawn.select("_p").distinct(), "_p", "left_semi") \
        .withColumn("_rn", F.row_number().over(Window.partitionBy("_p").orderBy("_hk", "_h", key_col)))
    return numbered.join(drawn, ["_p", "_rn"]).select(*[F.col(c) for c in df.columns], "draw_id")


#: A Poisson(1) weight is the number of these limits, of 2^32, that a uniform number reaches.
POISSON_LIMITS = [int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
#: Weights that one hash gives, each from eight of its digits.
WEIGHTS_A_HASH = 4


def bootstrap_replicates(df: DataFrame, value: Column, replicates: int, seed: int = 42, key_col: str = "row_key") -> DataFrame:
    """Bootstrap replicates of a value's summary from one pass: replicate, n_draws, mean, std, min, max.

    Every row has in every replicate a Poisson(1) number of draws, hashed from
    ``md5("<seed>:poisson:<block>:<key>")``: the limit of drawing as many rows as
    there are, without numbering them. The draws of a batch of rows
    are summed inside the task, so ``replicates`` rows a task are shuffled. Rows
    without a key or a value are in no draw.
    """
    v = value.cast("double")
    rows = df.select(F.col(key_col).cast("string").alias("_key"), v.alias("_v")).where(F.col("_key").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    limits = np.array(POISSON_LIMITS, np.int64)
    prefixes = [f"{seed}:poisson:{b}:".encode() for b in range((replicates - 1) // WEIGHTS_A_HASH + 1)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(replicates, np.int64), np.zeros((2, replicates))
        ends = np.vstack((np.full(replicates, np.inf), np.full(replicates, -np.inf)))
        for batch in batches:
            keys, values = [k.encode() for k in batch.column("_key").to_pylist()], batch.column("_v").to_numpy(zero_copy_only=False)
            for b, prefix in enumerate(prefixes if keys else []):
                hashes = b"".join([md5(prefix + k).digest() for k in keys])
                # eight hex digits are four bytes, the highest first
                weights = np.searchsorted(limits, np.frombuffer(hashes, ">u4").astype(np.int64), side="right").reshape(-1, WEIGHTS_A_HASH)
                for j, r in enumerate(range(b * WEIGHTS_A_HASH, min((b + 1) * WEIGHTS_A_HASH, replicates))):
                    own = np.flatnonzero(weights[:, j])
                    if len(own):
                        w, x = weights[own, j], values[own]
                        n[r] += w.sum()
                        sums[:, r] += (w * x).sum(), (w * x * x).sum()
                        ends[:, r] = min(ends[0, r], x.min()), max(ends[1, r], x.max())
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (np.arange(replicates, dtype=np.int32), n, *sums, *ends)], names=["replicate", "_n", "_s", "_q", "_low", "_high"])

    drawn = rows.mapInArrow(fold, "replicate int, _n long, _s double, _q double, _low double, _high double")
    n, total, square = F.sum("_n"), F.sum("_s"), F.sum("_q")
    spread = F.sqrt(F.greatest(F.try_divide(square - total * total / n, n - 1), F.lit(0.0)))
    return drawn.groupBy("replicate").agg(n.alias("n_draws"), (total / n).alias("mean"), spread.alias("std"), F.min("_low").alias("min"), F.max("_high").alias("max"))
