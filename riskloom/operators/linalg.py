"""Matrix-sized partial sums over a DataFrame (Gram, Fisher information, Newton terms).

Each partition folds its Arrow batches into one length-L vector with numpy;
the per-partition vectors are summed by a two-level tree (round-robin
regroup, then ``Summarizer.sum``), so no task ever holds more than a few
vectors of size L (L = p*p for p ~ 100 terms).  Only the final sum reaches the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _batch_matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
    if not cols:
        return np.zeros((batch.num_rows, 0))
    return np.column_stack([np.asarray(c, dtype="float64") for c in cols])


def partial_sums(df: DataFrame, x_cols: list[str], extra_cols: list[str], length: int,
                 kernel: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]) -> np.ndarray:
    """Sum ``kernel(X_batch, extras_batch)`` (a length-L vector) over all rows."""
    names = list(x_cols)
    extras = list(extra_cols)

    def fold(batches):
        acc = np.zeros(length, dtype="float64")
        for b in batches:
            if b.num_rows == 0:
                continue
            X = _batch_matrix(b, names)
            if not np.isfinite(X).all():
                bad = [n for n, ok in zip(names, np.isfinite(X).all(axis=0)) if not ok]
                raise ValueError(f"missing or non-finite values in {bad}: drop or impute them first")
            ex = {e: np.asarray(b.column(b.schema.get_field_index(e)).to_numpy(zero_copy_only=False),
                                dtype="float64") for e in extras}
            acc += kernel(X, ex)
        yield pa.RecordBatch.from_arrays([pa.array([acc], type=pa.list_(pa.float64()))], names=["s"])

    sel = df.select([F.col(c).cast("double").alias(c) for c in dict.fromkeys(names + extras)])
    parts = sel.mapInArrow(fold, "s array<double>")
    fan_in = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    vec = parts.select(array_to_vector("s").alias("v")).repartition(fan_in)
    row = vec.agg(Summarizer.sum(F.col("v")).alias("t")).first()
    if row is None or row["t"] is None:
        return np.zeros(length)
    return np.asarray(row["t"].toArray(), dtype="float64")


def gram_by_group(df: DataFrame, x_cols: list[str], group_col: str | None = None,
                  n_groups: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """XᵀX per group (integer group ids 0..n_groups-1) and row counts per group."""
    p = len(x_cols)
    g = max(1, n_groups)

    def kernel(X, ex):
        out = np.zeros(g * (p * p + 1))
        gid = ex[group_col].astype(int) if group_col else np.zeros(X.shape[0], dtype=int)
        for k in range(g):
            m = gid == k
            if not m.any():
                continue
            Xk = X[m]
            base = k * (p * p + 1)
            out[base:base + p * p] = (Xk.T @ Xk).ravel()
            out[base + p * p] = m.sum()
        return out

    flat = partial_sums(df, x_cols, [group_col] if group_col else [], g * (p * p + 1), kernel)
    grams = np.stack([flat[k * (p * p + 1):k * (p * p + 1) + p * p].reshape(p, p) for k in range(g)])
    counts = np.array([flat[k * (p * p + 1) + p * p] for k in range(g)])
    return grams, counts


def gram_matrix(df: DataFrame, x_cols: list[str]) -> np.ndarray:
    grams, _ = gram_by_group(df, x_cols)
    return grams[0]


def logistic_information(df: DataFrame, x_cols: list[str], beta: np.ndarray,
                         intercept: float = 0.0, with_intercept: bool = False) -> np.ndarray:
    """Fisher information Σ p(1-p) x xᵀ of a binary logit at ``beta``.

    ``with_intercept`` adds the constant as a last row and column.
    """
    p = len(x_cols) + with_intercept
    b = np.asarray(beta, dtype="float64")

    def kernel(X, ex):
        eta = X @ b + intercept
        mu = 1.0 / (1.0 + np.exp(-eta))
        w = mu * (1.0 - mu)
        if with_intercept:
            X = np.column_stack([X, np.ones(len(X))])
        return (X.T @ (X * w[:, None])).ravel()

    return partial_sums(df, x_cols, [], p * p, kernel).reshape(p, p)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Rows that are factored at once, so that they stay near the processor.
QR_ROWS = 1024


@dataclass(frozen=True)
class Packing:
    """Rows of a design as short arrays: the numeric terms' values, then for each list of ``levels`` the number of the level a row has (0: none).

    ``numeric`` and ``levels`` give the places of the terms (levels are numbered
    from 1 in their list), ``ones`` those of constants, which are not stored.
    """

    width: int
    numeric: tuple[int, ...]
    levels: tuple[tuple[int, ...], ...] = ()
    ones: tuple[int, ...] = ()

    @property
    def size(self) -> int:
        return len(self.numeric) + len(self.levels)

    def codes(self, rows: np.ndarray, i: int) -> np.ndarray:
        return rows[:, len(self.numeric) + i].astype(np.int64)

    def unpacked(self, rows: np.ndarray) -> np.ndarray:
        """The matrix of all terms."""
        X = np.zeros((len(rows), self.width))
        X[:, list(self.numeric)] = rows[:, :len(self.numeric)]
        X[:, list(self.ones)] = 1.0
        for i, places in enumerate(self.levels):
            code = self.codes(rows, i)
            own = np.flatnonzero(code)
            X[own, np.array(places)[code[own] - 1]] = 1.0
        return X


@dataclass
class Summary:
    """What one pass says of the columns on the rows of a group."""

    factor: np.ndarray      # triangular, RᵀR = XᵀX
    prints: np.ndarray      # a fingerprint a column
    n: int
    n_pos: int
    active: np.ndarray      # rows with a value above 0.5, and those of them that are positive
    active_pos: np.ndarray
    other: np.ndarray       # rows with a value that is neither 0 nor 1
    low: np.ndarray
    high: np.ndarray


def summaries(rows: DataFrame, packing: Packing, names: list[str], n_groups: int = 1) -> list[Summary]:
    """Per group a ``Summary`` of all columns, from one pass; rows: (x packed array, g group or 0, y 1 if positive).

    The factor is a tall-skinny QR: each partition folds its batches into one p x p
    factor, and factors are merged by the QR of one above the other, so nothing
    is squared and columns that differ by 1e-7 of their length are told apart.
    A fingerprint is the XOR of hash(row number, value) over the rows, the row
    number being the same for all columns: equal columns have equal ones. A
    missing value is refused.
    """
    p = packing.width
    plain = sorted({*range(p)} - {t for places in packing.levels for t in places})

    def sent(parts: dict[int, list[np.ndarray]]):
        flat = [np.concatenate((np.vstack((r, np.zeros((p - len(r), p)))).ravel(), s, low, high)) for r, _, s, low, high in parts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(flat, pa.list_(pa.float64())), pa.array([f.view(np.int64) for _, f, *_ in parts.values()], pa.list_(pa.int64()))], names=["g", "r", "f"])

    def factored(r, X):
        for at in range(0, len(X), QR_ROWS):
            block = X[at:at + QR_ROWS]
            r = np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")
        return r

    def merged(had, part):
        if had is None:
            return [factored(None, part[0]), *part[1:]]
        return [factored(had[0], part[0]), had[1] ^ part[1], had[2] + part[2], np.minimum(had[3], part[3]), np.maximum(had[4], part[4])]

    def looked_at(rows: np.ndarray, X: np.ndarray, y: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        n, dense = len(X), X[:, plain]
        prints, counts = np.zeros(p, np.uint64), np.zeros((3, p))
        prints[plain] = np.bitwise_xor.reduce(_mixed(_mixed((dense + 0.0).view(np.uint64)) ^ key[:, None]), axis=0)
        on = dense > 0.5
        counts[:, plain] = on.sum(axis=0), on[y > 0].sum(axis=0), ((dense != 0) & (dense != 1)).sum(axis=0)
        low, high = np.zeros(p), np.zeros(p)
        low[plain], high[plain] = dense.min(axis=0, initial=np.inf), dense.max(axis=0, initial=-np.inf)
        if packing.levels:
            # a level's column is 0 or 1: its print is that of zeros, changed in the rows that have the level
            zero, one = (_mixed(_mixed(np.array([v]).view(np.uint64)) ^ key) for v in (0.0, 1.0))
            nowhere, change = np.bitwise_xor.reduce(zero), zero ^ one
        for i, places in enumerate(packing.levels):
            code, at = packing.codes(rows, i), list(places)
            found = np.zeros(len(at) + 1, np.uint64)
            np.bitwise_xor.at(found, code, change)
            prints[at] = nowhere ^ found[1:]
            counts[0, at] = np.bincount(code, minlength=len(at) + 1)[1:]
            counts[1, at] = np.bincount(code[y > 0], minlength=len(at) + 1)[1:]
            low[at], high[at] = counts[0, at] == n, counts[0, at] > 0
        return [X, prints, np.concatenate(([n, (y > 0).sum()], counts.ravel())), low, high]

    def fold(batches):
        parts, seen, base = {}, 0, TaskContext.get().partitionId() << 33
        for b in batches:
            x = b.column("x")
            ends = x.offsets.to_numpy()
            packed = x.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(b.num_rows, packing.size)
            X = packing.unpacked(packed)
            if not np.isfinite(X).all():
                bad = [n for n, ok in zip(names, np.isfinite(X).all(axis=0)) if not ok]
                raise ValueError(f"missing or non-finite values in {bad}: drop or impute them first")
            key = _mixed(np.arange(base + seen, base + seen + len(X), dtype=np.uint64))
            seen += len(X)
            group, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "y"))
            for g in np.unique(group):
                own = group == g
                parts[int(g)] = merged(parts.get(int(g)), looked_at(packed[own], X[own], y[own], key[own]))
        yield from sent(parts)

    def merge(batches):
        parts = {}
        for b in batches:
            for g, r, f in zip(b.column("g").to_pylist(), b.column("r").to_pylist(), b.column("f").to_pylist()):
                r, s, low, high = np.split(np.array(r), [p * p, p * p + 2 + 3 * p, p * p + 2 + 4 * p])
                parts[g] = merged(parts.get(g), [r.reshape(p, p), np.array(f, np.int64).view(np.uint64), s, low, high])
        yield from sent(parts)

    schema = "g int, r array<double>, f array<long>"
    fan_in = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    made = rows.select("x", F.col("g").cast("int").alias("g"), F.col("y").cast("int").alias("y")).mapInArrow(fold, schema)
    found = {r["g"]: r for r in made.repartition(fan_in).mapInArrow(merge, schema).coalesce(1).mapInArrow(merge, schema).collect()}
    out = []
    for g in range(n_groups):
        if g not in found:
            none = np.zeros(p)
            out.append(Summary(np.zeros((p, p)), np.zeros(p, np.int64), 0, 0, none, none, none, none, none))
            continue
        r, s, low, high = np.split(np.array(found[g]["r"]), [p * p, p * p + 2 + 3 * p, p * p + 2 + 4 * p])
        out.append(Summary(r.reshape(p, p), np.array(found[g]["f"], np.int64), int(s[0]), int(s[1]), *s[2:].reshape(3, p), low, high))
    return out


def column_summary(df: DataFrame, x_cols: list[str], group_col: str | None = None, n_groups: int = 1) -> tuple[list[np.ndarray], list[list[int]]]:
    """Per group: a triangular factor R with RᵀR = XᵀX, and a fingerprint of every column (``summaries``)."""
    names = list(x_cols)
    x = F.array(*[F.col(c).cast("double") for c in names]).cast("array<double>")
    rows = df.select(x.alias("x"), (F.col(group_col) if group_col else F.lit(0)).alias("g"), F.lit(0).alias("y"))
    found = summaries(rows, Packing(len(names), tuple(range(len(names)))), names, n_groups)
    return [s.factor for s in found], [s.prints.tolist() for s in found]


def independent_columns(factor: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Greedy left-to-right independent columns, from a triangular factor of the data.

    Column j is kept if more than ``tol`` of its length is left beside the kept
    ones; lengths are those of the data itself, not their squares.
    """
    keep: list[int] = []
    basis = np.zeros((len(factor), 0))
    for j in range(factor.shape[1]):
        v = factor[:, j]
        rest = v - basis @ (basis.T @ v)
        rest = rest - basis @ (basis.T @ rest)
        size = np.linalg.norm(rest)
        if size > tol * np.linalg.norm(v):
            keep.append(j)
            basis = np.column_stack((basis, rest / size))
    return keep


def equal_columns(df: DataFrame, cols: list[str], prints: list[list[int]], wheres: list[Column]) -> list[dict[str, str]]:
    """For every filter: each column and the first column that equals it (itself, if none) on the rows of the filter.

    ``prints`` are the columns' fingerprints on these rows: only columns of one
    fingerprint are compared, value by value, all of them in one aggregation.
    """
    out = [{c: c for c in cols} for _ in wheres]
    todo = []
    for n, found in enumerate(prints):
        same: dict[int, list[str]] = {}
        for c, f in zip(cols, found):
            same.setdefault(f, []).append(c)
        todo += [(n, group) for group in same.values() if len(group) > 1]
    while todo:
        pairs = [(n, group[0], c) for n, group in todo for c in group[1:]]
        row = df.agg(*[F.coalesce(F.bool_and(F.when(wheres[n], F.col(a).eqNullSafe(F.col(b)))), F.lit(True)).alias(f"e{i}") for i, (n, a, b) in enumerate(pairs)]).first()
        rest: dict[tuple[int, str], list[str]] = {}
        for i, (n, a, b) in enumerate(pairs):
            if row[f"e{i}"]:
                out[n][b] = a
            else:
                rest.setdefault((n, a), []).append(b)
        todo = [(n, group) for (n, _), group in rest.items() if len(group) > 1]
    return out
