"""Scoring whole populations with a fitted logit: probabilities and Wald intervals.

The linear predictor is a plain column expression (coefficients as literals,
whole-stage codegen), and so is the quadratic form xᵀΣx that the interval needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalar import sigmoid
from riskloom.functions.sqltext import number
from riskloom.operators.fit import LogitModel
from riskloom.presets import Z_PREDICTION_INTERVAL


def linear_predictor_sql(model: LogitModel, overrides: dict | None = None) -> str:
    parts = [number(model.intercept)]
    for t, b in zip(model.terms, model.coef):
        if b != 0.0:
            parts.append(f"{number(b)} * {model.spec.term_sql(t, overrides)}")
    return "(" + " + ".join(parts) + ")"


def linear_predictor(model: LogitModel, overrides: dict | None = None) -> Column:
    """η = b0 + Σ b_j x_j as one parsed expression (coefficients are literals)."""
    return F.expr(linear_predictor_sql(model, overrides))


def quadratic_form(model: LogitModel, overrides: dict | None = None) -> Column:
    """xᵀΣx for the row's term vector.

    Dummies of one categorical column are mutually exclusive, so their cross
    products vanish; what remains is a plain expression (whole-stage codegen).
    A fitted intercept adds its own variance and covariances.
    """
    terms = model.terms
    src = model.spec.source
    cov = np.asarray(model.cov, dtype="float64")
    pairs = []
    for j in range(len(terms)):
        for k in range(j, len(terms)):
            if cov[j, k] == 0.0:
                continue
            (cj, lj), (ck, lk) = src[terms[j]], src[terms[k]]
            if j != k and cj == ck and lj is not None and lk is not None:
                continue            # two levels of one column are never both 1
            pairs.append((j, k))
    x = [model.spec.term_sql(t, overrides) for t in terms]
    parts = ["0.0D"]
    for j, k in pairs:
        w = cov[j, k] if j == k else 2.0 * cov[j, k]
        prod = x[j] if (j == k and src[terms[j]][1] is not None) else f"{x[j]} * {x[k]}"
        parts.append(f"{number(w)} * {prod}")
    const = model.info.get("intercept_cov")
    if const is not None:
        parts += [number(const[-1]), *(f"{number(2.0 * c)} * {v}" for c, v in zip(const, x))]
    return F.expr("(" + " + ".join(parts) + ")")


def interval_columns(model: LogitModel, overrides: dict | None = None,
                     z: float = Z_PREDICTION_INTERVAL, prefix: str = "") -> list[Column]:
    """Predicted_Probability, CI_Lower_95, CI_Upper_95 (NULL bounds without covariance)."""
    eta = linear_predictor(model, overrides)
    p = sigmoid(eta).alias(f"{prefix}Predicted_Probability")
    if model.cov is None:
        return [p, F.lit(None).cast("double").alias(f"{prefix}CI_Lower_95"),
                F.lit(None).cast("double").alias(f"{prefix}CI_Upper_95")]
    var = quadratic_form(model, overrides)
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return [p, sigmoid(eta - F.lit(z) * se).alias(f"{prefix}CI_Lower_95"),
            sigmoid(eta + F.lit(z) * se).alias(f"{prefix}CI_Upper_95")]


def batch_score(df: DataFrame, model: LogitModel, out_col: str = "Predicted_Probability") -> DataFrame:
    """Inputs plus the predicted probability (no UDF, pure codegen)."""
    return df.select("*", sigmoid(linear_predictor(model)).alias(out_col))


#: Terms up to which a quadratic form is an expression; for more it would be too long to parse, and its code too long for a method.
EXPRESSION_TERMS = 16


def score_with_interval(df: DataFrame, model: LogitModel, z: float = Z_PREDICTION_INTERVAL) -> DataFrame:
    """Inputs plus probability and Wald interval on the logit scale.

    Up to ``EXPRESSION_TERMS`` terms this is an expression; wider models take
    the quadratic form as a matrix product on Arrow batches.
    """
    p = len(model.terms)
    if model.cov is None or p <= EXPRESSION_TERMS:
        return df.select("*", *interval_columns(model, z=z))
    b, cov, const = np.asarray(model.coef, dtype="float64"), np.asarray(model.cov, dtype="float64"), model.info.get("intercept_cov")
    intercept, names = float(model.intercept), [*df.columns, "Predicted_Probability", "CI_Lower_95", "CI_Upper_95"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x = batch.num_rows, batch.column(batch.num_columns - 1)
            X = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, p)
            eta, var = X @ b + intercept, ((X @ cov) * X).sum(axis=1)
            if const is not None:
                var = var + const[-1] + 2.0 * (X @ np.asarray(const[:p]))
            half = z * np.sqrt(np.clip(var, 0.0, None))
            scores = [pa.array(1.0 / (1.0 + np.exp(-np.clip(v, -700.0, 700.0))), from_pandas=True) for v in (eta, eta - half, eta + half)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *scores], names=names)

    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names[-3:]]])
    return df.select("*", F.array(*[model.spec.term_expr(t).cast("double") for t in model.terms]).alias("_x")).mapInArrow(run, schema)
