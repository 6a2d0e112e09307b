"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers and kept in segments; within a segment each
attribute is a stack of bitmaps, one for every binary digit of all its rows. A
query's weights are written in signed binary digits, so the scores of a whole
segment are a sum of shifted slices, which carry-save adders add up column by
column with bitmap AND, OR and XOR only. The top rows are then read off the sum from the most
significant slice downward: rows with a 1 are above those with a 0, until the
k-th row's boundary; the rows tied at the boundary are resolved exactly, by id.
Segment results (k a segment) meet in a window that keeps k a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a segment at most, segments at least, queries in a block at most.
SEGMENT_ROWS, MIN_SEGMENTS, QUERY_BLOCK = 65_536, 8, 4_096


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, q array<long>): floor(scale * x) with x as double; vectors null or with null or non-finite components go."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(~bad) \
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))


def _words(bits: np.ndarray) -> np.ndarray:
    """Booleans as one bitmap of 64-bit words."""
    packed = np.packbits(bits, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


class Slices:
    """The bit-sliced index of a segment: digits of each attribute's value less its minimum."""

    def __init__(self, values: np.ndarray):
        self.n, self.dims = values.shape
        self.low = values.min(axis=0) if self.n else np.zeros(self.dims, np.int64)
        rest = values - self.low
        self.bits = [[_words(rest[:, d] >> b & 1) for b in range(int(rest[:, d].max()).bit_length())] for d in range(self.dims)]
        self.all = _words(np.ones(self.n, bool))


def signed_digits(w: int) -> list[tuple[int, int]]:
    """Non-adjacent form of an integer: (place, +1 or -1)."""
    out, place = [], 0
    while w:
        if w & 1:
            digit = 2 - (w & 3)
            out.append((place, digit))
            w -= digit
        w >>= 1
        place += 1
    return out


def sums(index: Slices, weights: list[int]) -> tuple[list[np.ndarray], int]:
    """(slices of each row's score less a constant, that constant); no slice is negative."""
    columns: dict[int, list[np.ndarray]] = {}
    base = 0
    for d, w in enumerate(weights):
        base += w * int(index.low[d])
        for place, digit in signed_digits(w):
            for b, slice_ in enumerate(index.bits[d]):
                # -x = ~x - 1 on one binary digit
                columns.setdefault(place + b, []).append(slice_ if digit > 0 else slice_ ^ index.all)
                base -= (1 << place + b) * (digit < 0)
    out, place = [], 0
    while columns:
        stack = columns.pop(place, [])
        carries = columns.setdefault(place + 1, [])
        while len(stack) > 2:
            x, y, z = stack.pop(), stack.pop(), stack.pop()
            xy = x ^ y
            stack.insert(0, xy ^ z)
            carries.append((x & y) | (xy & z))
        if len(stack) == 2:
            x, y = stack
            stack = [x ^ y]
            carries.append(x & y)
        out.append(stack[0] if stack else index.all & np.uint64(0))
        if not carries:
            columns.pop(place + 1)
        place += 1
    return out, base


def top(slices: list[np.ndarray], allowed: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows above the boundary, rows tied at it) of the k best allowed rows."""
    sure, maybe = np.zeros_like(allowed), allowed
    for s in reversed(slices):
        ones = sure | (maybe & s)
        if int(np.bitwise_count(ones).sum()) > k:
            maybe = maybe & s
        else:
            sure, maybe = ones, maybe & ~s
    rows = [np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little", count=n)) for x in (sure, maybe)]
    return rows[0], rows[1]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """For each row of ``queries`` the k rows of ``vectors`` with the highest integer inner product, but for its own id.

    Returns query_id, rank (from 1), vec_id, score; equal scores go to the
    smaller vec_id; fewer than k rows if there are fewer. Null ids and vectors
    that are null or hold null or non-finite components take no part, on both
    sides; vectors of different lengths are scored on the places both have.
    Repeated ids are rows of their own, repeated query ids answer once.
    """
    data = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale).dropDuplicates(["vec_id"])
    segments = max(MIN_SEGMENTS, math.ceil(data.count() / SEGMENT_ROWS))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))

    def as_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [grid(b.column("vec_id"), b.column("q")) for b in batches if b.num_rows]
        if parts:
            dims = max(g.shape[1] for _, g in parts)
            ids = np.concatenate([i for i, _ in parts])
            values = np.concatenate([np.pad(g, ((0, 0), (0, dims - g.shape[1]))) for _, g in parts])
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([ids[order].tobytes()]), pa.array([values[order].tobytes()])], ["ids", "grid"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 3), np.int64)]
        if left.num_rows and right.num_rows:
            ids = np.frombuffer(left.column("ids")[0].as_py(), np.int64)
            index = Slices(np.frombuffer(left.column("grid")[0].as_py(), np.int64).reshape(len(ids), -1))
            names, weights = grid(right.column("vec_id").combine_chunks(), right.column("q").combine_chunks())
            for name, w in zip(names, weights[:, :index.dims].tolist()):
                slices, base = sums(index, w)
                own = ids == name
                allowed = index.all & ~_words(own) if own.any() else index.all
                sure, tied = top(slices, allowed, index.n, k)
                best = np.concatenate((sure, tied[:k - len(sure)]))  # ids ascend within a segment
                score = np.full(len(best), base, np.int64)
                for b, bits in enumerate(slices):
                    score += (bits[best >> 6] >> (best & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
                out.append(np.stack((np.full(len(best), name, np.int64), ids[best], score), axis=1))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), np.concatenate(out).T)))

    # each block of the stated queries meets each segment once
    index = data.repartition(segments).mapInArrow(as_segment, "ids binary, grid binary").withColumn("segment", F.spark_partition_id()) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")) \
        .withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    found = index.groupBy("segment", "block").cogroup(asked.groupBy("segment", "block")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def grid(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a batch; shorter vectors are filled up with zeros."""
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max())), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = np.asarray(vectors.values)[offsets[0]:offsets[-1]]
    return np.asarray(ids).astype(np.int64), out


def nearest(vectors: DataFrame, k: int = 10) -> DataFrame:
    """Queries: every row whose vec_id is divisible by 100, against all rows."""
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k)
