"""Numeric checks of the fits on seeded frames with known parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.design import DesignSpec, fit_design, prune_design
from riskloom.operators.fit import logit_l1, logit_mle
from riskloom.operators.ordinal import ordered_logit, ordered_predict


def _frame(spark, n=20000, seed=7):
    rng = np.random.default_rng(seed)
    x1 = rng.normal(size=n)
    cat = rng.choice(["a", "b", "c"], size=n, p=[0.5, 0.3, 0.2])
    eta = 0.8 * x1 + np.where(cat == "b", 0.5, 0.0) + np.where(cat == "c", -0.7, 0.0)
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    lat = eta + rng.logistic(size=n)
    k = np.digitize(lat, [-0.5, 1.0]) + 1
    rows = [(f"r{i}", float(x1[i]), str(cat[i]), int(y[i]), int(k[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_key string, x1 double, cat string, y int, k int")


def _numpy_logit(X, y):
    b = np.zeros(X.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ b))
        H = (X * (mu * (1 - mu))[:, None]).T @ X
        step = np.linalg.solve(H, X.T @ (y - mu))
        b += step
        if np.abs(step).max() < 1e-12:
            break
    return b, np.linalg.inv(H)


def test_logit_mle_matches_newton_and_recovers(spark):
    df = _frame(spark)
    spec = fit_design(df, ["x1", "cat"], ["cat"])
    assert spec.terms == ["x1", "cat_b", "cat_c"]
    m = logit_mle(df, spec, "y")
    pdf = spec.encode(df, keep=["y"]).toPandas()
    b, cov = _numpy_logit(pdf[spec.terms].to_numpy(float), pdf["y"].to_numpy(float))
    assert np.allclose(m.coef, b, atol=1e-8)
    assert np.allclose(m.cov, cov, rtol=1e-6)
    assert np.allclose(m.coef, [0.8, 0.5, -0.7], atol=0.12)


def test_l1_kkt(spark):
    df = _frame(spark, 5000)
    spec = fit_design(df, ["x1", "cat"], ["cat"])
    alpha = 50.0
    m = logit_l1(df, spec, "y", alpha=alpha, tol=1e-10, max_iter=5000)
    pdf = spec.encode(df, keep=["y"]).toPandas()
    X = pdf[spec.terms].to_numpy(float)
    y = pdf["y"].to_numpy(float)
    g = X.T @ (y - 1 / (1 + np.exp(-X @ m.coef)))
    for j, bj in enumerate(m.coef):
        if bj != 0:
            assert abs(abs(g[j]) - alpha) < 0.05 * alpha
        else:
            assert abs(g[j]) <= alpha * 1.05


def test_ordered_logit_recovers_and_two_classes_equal_binary(spark):
    df = _frame(spark)
    spec = fit_design(df, ["x1", "cat"], ["cat"])
    m = ordered_logit(df, spec, "k", [1, 2, 3])
    assert m.converged
    assert np.allclose(m.beta, [0.8, 0.5, -0.7], atol=0.12)
    assert np.allclose(m.cuts, [-0.5, 1.0], atol=0.12)
    # K = 2 is a binary logit with intercept -theta
    df2 = df.withColumn("k2", F.when(F.col("k") >= 2, 2).otherwise(1)).withColumn("yb", (F.col("k") >= 2).cast("int"))
    m2 = ordered_logit(df2, spec, "k2", [1, 2])
    b = logit_mle(df2, spec, "yb", fit_intercept=True, with_covariance=False)
    assert np.allclose(m2.beta, b.coef, atol=1e-5)
    assert abs(m2.cuts[0] + b.intercept) < 1e-5
    pred = ordered_predict(df.limit(100), m)
    p = pred.select(F.col("p_1") + F.col("p_2") + F.col("p_3")).toPandas().to_numpy()
    assert np.allclose(p, 1.0)


def test_prune_drops_duplicates_and_dependent(spark):
    df = _frame(spark, 2000).withColumn("cat2", F.col("cat")).withColumn("x2", F.col("x1") * 2.0)
    spec = fit_design(df, ["x1", "x2", "cat", "cat2"], ["cat", "cat2"])
    pruned = prune_design(spec, df, "y")
    assert pruned.terms == ["x1", "cat_b", "cat_c"]
    assert pruned.dropped["cat2_b"].startswith("duplicate")
    assert pruned.dropped["x2"].startswith("dependent")
