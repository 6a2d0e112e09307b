"""Binary logit fits, with the full coefficient covariance.

* ``logit_mle`` - Newton's method (``newton``): one distributed pass a step, over
  patterns if all terms are levels; the last step's information gives the full
  covariance. ``logit_or_l1`` goes over to the L1 fit where the data separate.
* ``logit_l1`` / ``logit_l2`` - Spark ML's LogisticRegression with an elastic-net penalty.

Only coefficient-sized results reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import newton as NW
from riskloom.operators.design import DesignSpec
from riskloom.presets import Z_COEF_INTERVAL


@dataclass
class LogitModel:
    spec: DesignSpec
    coef: np.ndarray
    cov: np.ndarray | None = None
    intercept: float = 0.0
    fit_type: str = "MLE"
    converged: bool = True
    iterations: int = 0
    se: np.ndarray | None = None
    pvalues: np.ndarray | None = None
    info: dict = field(default_factory=dict)
    separated: bool = False

    @property
    def terms(self) -> list[str]:
        return self.spec.terms


def _normal_sf(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2.0)) for v in np.atleast_1d(z)])


def _assemble(df: DataFrame, spec: DesignSpec, y_col: str, weight_col: str | None = None) -> DataFrame:
    enc = spec.encode(df, keep=[y_col] + ([weight_col] if weight_col else []))
    va = VectorAssembler(inputCols=spec.terms, outputCol="features", handleInvalid="keep")
    return va.transform(enc).select(F.col(y_col).cast("double").alias("label"), "features",
                                    *([F.col(weight_col)] if weight_col else []))


def logit_mle(df: DataFrame, spec: DesignSpec, y_col: str, *, fit_intercept: bool = False,
              max_iter: int = 100, tol: float = 1e-6, with_covariance: bool = True) -> LogitModel:
    """Unpenalised binary logit by Newton's method (one convex optimum: no solver ladder).

    ``separated`` is true if the outcome is decided by some term, so that no
    finite optimum exists; such a model has not converged.
    """
    if not spec.terms:
        raise ValueError("no terms left to fit")
    problem = NW.binary_problem(df, spec, y_col, fit_intercept, max_iter, tol)
    NW.solve(df.sparkSession, [problem])
    return mle_model(problem, spec, fit_intercept, with_covariance)


def mle_model(problem: NW.Problem, spec: DesignSpec, fit_intercept: bool = False, with_covariance: bool = True) -> LogitModel:
    """The fitted model of a solved problem; standard errors from the information of the last step."""
    k = len(spec.terms)
    coef, intercept = problem.at[:k], float(problem.at[k]) if fit_intercept else 0.0
    full = problem.covariance()
    se = pv = None
    if full is not None:
        # of the coefficients; the intercept's uncertainty is in it, its own row is kept apart
        se = np.sqrt(np.clip(np.diag(full)[:k], 0, None))
        pv = _normal_sf(coef / np.where(se > 0, se, np.nan))
    keep = full is not None and with_covariance
    return LogitModel(spec, coef, full[:k, :k] if keep else None, intercept, "MLE", problem.converged, problem.iterations, se, pv,
                      {"intercept_cov": full[k]} if keep and fit_intercept else {}, problem.separated)


def logit_or_l1(df: DataFrame, spec: DesignSpec, y_col: str, alpha: float = 0.01, **kw) -> LogitModel:
    """The unpenalised fit, or the L1 fit where the data separate (its ``fit_type`` says which)."""
    model = logit_mle(df, spec, y_col, **kw)
    return logit_l1(df, spec, y_col, alpha=alpha) if model.separated or model.cov is None else model


def logit_penalized(df: DataFrame, spec: DesignSpec, y_col: str, *, alpha: float, l1_ratio: float,
                    fit_intercept: bool = False, max_iter: int = 1000, tol: float = 1e-8,
                    n_rows: int | None = None, zero_tol: float = 1e-8) -> LogitModel:
    """Penalised logit minimising -logL + alpha * penalty (sum-scale, as in the analysis).

    Spark scales the loss by 1/n, so ``regParam = alpha / n``.
    """
    # the fit keeps its own blocks of the vectors, so they are not kept here as well
    data = _assemble(df, spec, y_col)
    n = n_rows if n_rows is not None else df.count()
    lr = LogisticRegression(featuresCol="features", labelCol="label", fitIntercept=fit_intercept,
                            standardization=False, elasticNetParam=l1_ratio,
                            regParam=alpha / max(1, n), maxIter=max_iter, tol=tol)
    m = lr.fit(data)
    coef = np.array(m.coefficients.toArray(), dtype="float64")
    coef[np.abs(coef) < zero_tol] = 0.0
    kind = "Regularized (L1)" if l1_ratio == 1.0 else "Regularized (L2)" if l1_ratio == 0.0 else "Elastic net"
    iters = int(m.summary.totalIterations) if m.hasSummary else 0
    return LogitModel(spec, coef, None, float(m.intercept), kind, iters < max_iter, iters,
                      info={"objective_history": list(m.summary.objectiveHistory) if m.hasSummary else []})


def logit_l1(df: DataFrame, spec: DesignSpec, y_col: str, alpha: float = 0.1, **kw) -> LogitModel:
    return logit_penalized(df, spec, y_col, alpha=alpha, l1_ratio=1.0, **kw)


def logit_l2(df: DataFrame, spec: DesignSpec, y_col: str, C: float = 1.0, **kw) -> LogitModel:
    """L2 logit with sklearn's C convention: minimise C * (-logL) + ||b||²/2."""
    return logit_penalized(df, spec, y_col, alpha=1.0 / C, l1_ratio=0.0, **kw)


TERM_SCHEMA = T.StructType([
    T.StructField("Term", T.StringType()),
    T.StructField("Variable", T.StringType()),
    T.StructField("Level", T.StringType()),
    T.StructField("Coefficient", T.DoubleType()),
    T.StructField("Std_Error", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
])


def term_table(spark: SparkSession, model: LogitModel) -> DataFrame:
    """(Term, Variable, Level, Coefficient, Std_Error, p_value): p rows."""
    rows = []
    for i, t in enumerate(model.terms):
        var, lv = model.spec.source[t]
        se = None if model.se is None or not np.isfinite(model.se[i]) else float(model.se[i])
        pv = None if model.pvalues is None or not np.isfinite(model.pvalues[i]) else float(model.pvalues[i])
        rows.append((t, var, lv, float(model.coef[i]), se, pv))
    return spark.createDataFrame(rows, TERM_SCHEMA)


def odds_ratios(terms: DataFrame, z: float = Z_COEF_INTERVAL) -> DataFrame:
    """Odds ratio with Wald interval, sorted by odds ratio descending; OR only if no SE."""
    b = F.col("Coefficient")
    se = F.col("Std_Error")
    return terms.select(
        "Term", "Coefficient", F.exp(b).alias("Odds_Ratio"),
        F.exp(b - F.lit(z) * se).alias("CI_Lower_95"), F.exp(b + F.lit(z) * se).alias("CI_Upper_95"),
        "p_value").orderBy(F.desc("Odds_Ratio"), F.asc("Term"))


def fit_report(spark: SparkSession, model: LogitModel, label: str) -> DataFrame:
    return spark.createDataFrame(
        [(label, model.fit_type, bool(model.converged), int(model.iterations), len(model.terms),
          int(np.count_nonzero(model.coef)))],
        "Model string, Fit_Type string, Converged boolean, Iterations int, N_Terms int, N_Nonzero int")
