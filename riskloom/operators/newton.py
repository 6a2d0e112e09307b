"""Newton's method for many logit models at once.

Every step is ONE data pass for all models that still move: each partition folds
its Arrow batches into one vector a model (log-likelihood, gradient, information)
with numpy, the vectors are tree-added, and the steps are solved on the driver.
A step that lowers a model's likelihood, or breaks the order of its cut points,
is halved and tried with the next pass.

A design whose terms are all level indicators is grouped first by its columns
and the class (a *pattern table*, kept in the shared folder): a step then reads
patterns with weights, not rows. Designs with numeric terms keep the row path.

Separation is watched on the way: if the data say nothing more about a term (its
standard error, for one unit of it, passes ``SEPARATED_SE`` while its coefficient
runs away), the fit stops and says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.design import DesignSpec
from riskloom.operators.linalg import Packing
from riskloom.session import at_once, checkpointed, kept, release

#: Standard error (of the log odds, for a typical value of the term) at which a term counts as separated.
SEPARATED_SE = 100.0


@dataclass
class Problem:
    """One model: rows (k class index, w weight, x array of terms, ``packing`` if they are packed), and the state of its fit.

    ``classes`` 0 is a binary logit of k on x; K >= 2 is an ordered logit with
    K - 1 cut points before the coefficients.
    """

    data: DataFrame
    terms: int
    classes: int = 0
    max_iter: int = 100
    tol: float = 1e-6
    start: np.ndarray | None = None
    patterns: bool = False
    packing: Packing | None = None
    at: np.ndarray | None = None
    loglik: float = -math.inf
    information: np.ndarray | None = None
    scale: np.ndarray | None = None
    iterations: int = 0
    converged: bool = False
    separated: bool = False
    done: bool = False
    history: list[float] = field(default_factory=list)
    rows: DataFrame | None = None       # the rows as they are kept while the problem is solved
    _step: np.ndarray | None = None
    _share: float = 1.0
    _halved: int = 0

    @property
    def cuts(self) -> int:
        return max(self.classes - 1, 0)

    @property
    def size(self) -> int:
        return self.cuts + self.terms

    def trial(self) -> np.ndarray:
        if self.at is None:
            return np.zeros(self.size) if self.start is None else self.start
        return self.at + self._share * self._step

    def _halve(self) -> None:
        self._share /= 2
        self._halved += 1
        if self._halved > 30:
            self.done = True

    def take(self, sums: np.ndarray) -> None:
        """The sums of one pass at the trial point: go there and plan the next step, or halve this one."""
        n = self.size
        value, gradient, information = sums[0], sums[1:1 + n], sums[1 + n:1 + n + n * n].reshape(n, n)
        trial = self.trial()
        if self.at is not None and not (np.isfinite(value) and value >= self.loglik - 1e-12 * abs(self.loglik)):
            self._halve()
        else:
            moved = None if self.at is None else np.max(np.abs(self._share * self._step) * self.scale)
            gain = value - self.loglik
            self.at, self.loglik, self.information = trial, value, information
            self.history.append(value)
            if self.scale is None:
                count, square = sums[1 + n + n * n:1 + n + n * n + self.terms], sums[1 + n + n * n + self.terms:]
                self.scale = np.concatenate((np.ones(self.cuts), np.sqrt(np.where(count > 0, square / np.maximum(count, 1), 1.0))))
            d = np.sqrt(np.clip(np.diag(information), 1e-300, None))
            try:
                inverse = np.linalg.inv(information / np.outer(d, d)) / np.outer(d, d)
                self._step = inverse @ gradient
                errors = np.sqrt(np.clip(np.diag(inverse), 0, None)) * self.scale
                self.separated = self.iterations >= 5 and bool(np.any((errors > SEPARATED_SE) & (np.abs(trial) * self.scale > 5)))
            except np.linalg.LinAlgError:
                self._step = np.linalg.lstsq(information, gradient, rcond=None)[0]
            if moved is not None and (moved < self.tol or abs(gain) <= 1e-14 * abs(value)):
                self.converged = self.done = True
            if self.separated:
                self.converged, self.done = False, True
            self._share, self._halved = 1.0, 0
            if not self.done:
                self.iterations += 1
                self.done = self.iterations > self.max_iter
        while not self.done and self.cuts > 1 and np.any(np.diff(self.trial()[:self.cuts]) <= 0):
            self._halve()

    def covariance(self) -> np.ndarray | None:
        d = np.sqrt(np.clip(np.diag(self.information), 1e-300, None))
        try:
            return np.linalg.inv(self.information / np.outer(d, d)) / np.outer(d, d)
        except np.linalg.LinAlgError:
            return None


def _sig(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))


def _binary(X: np.ndarray, k: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    eta = X @ at
    p = _sig(eta)
    # log p of what was seen, from the side that does not cancel
    value = -(w * np.logaddexp(0.0, np.where(k > 0, -eta, eta))).sum()
    return np.concatenate(([value], X.T @ (w * (k - p)), (X.T @ (X * (w * p * (1 - p))[:, None])).ravel()))


def _ordered(X: np.ndarray, k: np.ndarray, w: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Of P(y <= k) = sigmoid(cut_k - x b): each row touches the cut above it and the one below."""
    n, p = len(k), X.shape[1]
    limits = np.concatenate(([-np.inf], at[:m], [np.inf]))
    eta = X @ at[m:] if p else np.zeros(n)
    a, b = limits[k + 1] - eta, limits[k] - eta
    top, low = k == m, k == 0
    Fa, Fb = np.where(top, 1.0, _sig(np.where(top, 0.0, a))), np.where(low, 0.0, _sig(np.where(low, 0.0, b)))
    fa, fb = np.where(top, 0.0, Fa * (1 - Fa)), np.where(low, 0.0, Fb * (1 - Fb))
    # both limits far up: from the other tail, where the difference does not cancel
    pr = np.clip(np.where(b > 0, _sig(-b) - np.where(top, 0.0, _sig(-a)), Fa - Fb), 1e-300, None)
    ga, gb = fa / pr, -fb / pr                    # d log pr / d upper and lower limit
    haa, hbb = fa * (1 - 2 * Fa) / pr - ga * ga, -fb * (1 - 2 * Fb) / pr - gb * gb
    hab = -ga * gb
    # the row's derivative by all parameters is A * d upper + B * d lower, with A = (e_k, -x), B = (e_{k-1}, -x)
    A, B = np.zeros((n, m + p)), np.zeros((n, m + p))
    rows = np.arange(n)
    A[rows[~top], k[~top]] = 1.0
    B[rows[~low], k[~low] - 1] = 1.0
    A[:, m:] = B[:, m:] = -X
    gradient = A.T @ (w * ga) + B.T @ (w * gb)
    cross = A.T @ (B * (w * hab)[:, None])
    H = A.T @ (A * (w * haa)[:, None]) + B.T @ (B * (w * hbb)[:, None]) + cross + cross.T
    return np.concatenate(([(w * np.log(pr)).sum()], gradient, -H.ravel()))


def _pass(spark: SparkSession, problems: list[Problem]) -> list[np.ndarray]:
    """The sums of every problem at its trial point, from one job over all their rows."""
    todo = [(p.packing or Packing(p.terms, tuple(range(p.terms))), p.classes, p.cuts, p.trial(), p.scale is None) for p in problems]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            model = batch.column("m").to_numpy(zero_copy_only=False)
            k, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "w"))
            x, ends = batch.column("x"), batch.column("x").offsets.to_numpy()
            flat = x.values.to_numpy(zero_copy_only=False)
            for i in np.unique(model):
                packing, classes, cuts, at, first = todo[i]
                own = np.flatnonzero(model == i)
                lo, hi = own[0], own[-1] + 1
                X = packing.unpacked(flat[ends[lo]:ends[hi]].reshape(len(own), packing.size) if hi - lo == len(own) else flat[(ends[own][:, None] + np.arange(packing.size))])
                if not np.isfinite(X).all():
                    raise ValueError(f"missing or non-finite values in terms {np.flatnonzero(~np.isfinite(X).all(axis=0)).tolist()}: drop or impute them first")
                part = _ordered(X, k[own], w[own], at, cuts) if classes else _binary(X, k[own], w[own], at)
                if first:
                    used = (X != 0) * w[own][:, None]
                    part = np.concatenate((part, used.sum(axis=0), (X * X * w[own][:, None]).sum(axis=0)))
                sums[i] = sums[i] + part if i in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["m", "s"])

    union = None
    for i, p in enumerate(problems):
        rows = (p.data if p.rows is None else p.rows).select(F.lit(i).alias("m"), "k", "w", "x")
        union = rows if union is None else union.unionByName(rows)
    parts = union.mapInArrow(fold, "m int, s array<double>").select("m", array_to_vector("s").alias("v"))
    fan_in = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = {r["m"]: np.asarray(r["t"].toArray()) for r in parts.repartition(fan_in).groupBy("m").agg(Summarizer.sum(F.col("v")).alias("t")).collect()}
    return [found.get(i) for i in range(len(problems))]


def _narrow(p: Problem) -> DataFrame:
    """The rows of a problem with a column a value, numbers of levels as integers: as a table a few bytes a row, where arrays of doubles cannot be compressed."""
    packing = p.packing or Packing(p.terms, tuple(range(p.terms)))
    values = [F.get("x", F.lit(i)) for i in range(packing.size)]
    values = [v if i < len(packing.numeric) else v.cast("int") for i, v in enumerate(values)]
    return p.data.select("k", "w", *[v.alias(f"x{i}") for i, v in enumerate(values)])


def solve(spark: SparkSession, problems: list[Problem]) -> list[Problem]:
    """Fit all problems; a pass serves every one that is not done yet."""
    held: list[DataFrame] = []
    try:
        wide = [p for p in problems if not p.patterns]
        held = at_once(spark, [partial(kept, _narrow(p)) for p in wide])
        for p, d in zip(wide, held):
            p.rows = d.select("k", "w", F.array(*[F.col(c).cast("double") for c in d.columns[2:]]).cast("array<double>").alias("x"))
        while moving := [p for p in problems if not p.done]:
            for p, sums in zip(moving, _pass(spark, moving)):
                if sums is None:
                    raise ValueError("no rows to fit")
                p.take(sums)
    finally:
        release(held)
        for p in problems:
            p.rows = None
    return problems


def problem_rows(df: DataFrame, spec: DesignSpec, k: Column, intercept: bool = False) -> tuple[DataFrame, bool]:
    """(k, w, x packed) of a design, and whether they are patterns: rows grouped once by the design's columns if all terms are levels."""
    columns = list(dict.fromkeys(spec.variable_of(t) for t in spec.terms))
    grouped = bool(columns) and all(spec.source[t][1] is not None for t in spec.terms)
    weight = F.lit(1.0)
    if grouped:
        df = df.select(k.cast("int").alias("_k"), *columns).groupBy("_k", *columns).agg(F.count(F.lit(1)).cast("double").alias("_w"))
        k, weight = F.col("_k"), F.col("_w")
    rows = df.select(k.cast("int").alias("k"), weight.alias("w"), spec.packed(intercept)[0].alias("x")).where(F.col("k").isNotNull())
    return (checkpointed(rows) if grouped else rows), grouped


def binary_problem(df: DataFrame, spec: DesignSpec, y_col: str, intercept: bool = False, max_iter: int = 100, tol: float = 1e-6) -> Problem:
    rows, grouped = problem_rows(df, spec, F.col(y_col), intercept)
    return Problem(rows, len(spec.terms) + intercept, 0, max_iter, tol, patterns=grouped, packing=spec.packed(intercept)[1])


def ordered_problem(df: DataFrame, spec: DesignSpec, y_col: str, classes: list[int], max_iter: int = 50, tol: float = 1e-6) -> Problem:
    """Starts at the cut points of the class shares, without effects of the terms."""
    y = F.col(y_col).cast("int")
    rows, grouped = problem_rows(df, spec, F.coalesce(*[F.when(y == c, F.lit(i)) for i, c in enumerate(classes)]))
    counts = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.sum("w").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        raise ValueError("ordered logit: no rows left after the class filter and missing-value removal")
    upto = np.clip(np.cumsum([counts.get(i, 0) for i in range(len(classes))])[:-1] / total, 1e-6, 1 - 1e-6)
    cuts = np.maximum.accumulate(np.log(upto / (1 - upto)) + np.arange(len(classes) - 1) * 1e-6)
    return Problem(rows, len(spec.terms), len(classes), max_iter, tol, start=np.concatenate((cuts, np.zeros(len(spec.terms)))), patterns=grouped, packing=spec.packed()[1])
