"""Batched Newton, pattern tables, separation, exact duplicates and rank on frames where the answer is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import newton as NW
from riskloom.operators.design import fit_design, prune_design, stats_of, term_stats
from riskloom.operators.fit import logit_mle, logit_or_l1
from riskloom.operators.linalg import column_summary, equal_columns, independent_columns, summaries
from riskloom.operators.ordinal import ordered_logit


def _plain(X, y):
    b = np.zeros(X.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ b))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X, X.T @ (y - p))
        b += step
        if np.abs(step).max() < 1e-13:
            break
    return b, np.linalg.inv((X * (p * (1 - p))[:, None]).T @ X)


def _plain_ordered(X, k, K):
    """Maximum of the ordered log-likelihood by Newton with numeric derivatives of an independent formula."""
    m, p = K - 1, X.shape[1]

    def gradient(t):
        cuts, b = np.concatenate(([-np.inf], t[:m], [np.inf])), t[m:]
        with np.errstate(over="ignore"):
            up, lo = (1 / (1 + np.exp(-(cuts[k + s] - X @ b))) for s in (1, 0))
        pr = up - lo
        du, dl = up * (1 - up), lo * (1 - lo)
        g = [((k == j) * du / pr - (k == j + 1) * dl / pr).sum() for j in range(m)]
        return np.array(g + list(X.T @ ((dl - du) / pr)))
    t = np.concatenate((np.log(np.cumsum(np.bincount(k, minlength=K))[:-1] / (len(k) - np.cumsum(np.bincount(k, minlength=K))[:-1])), np.zeros(p)))
    for _ in range(30):
        J = np.stack([(gradient(t + 1e-5 * e) - gradient(t - 1e-5 * e)) / 2e-5 for e in np.eye(m + p)], axis=1)
        step = np.linalg.solve(J, gradient(t))
        t = t - step
        if np.abs(step).max() < 1e-11:
            break
    return t


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 4000
    a, b, x = rng.choice(list("pqr"), n), rng.choice(["u", "v"], n), rng.normal(2000, 5, n)
    eta = 0.6 * (a == "q") - 0.9 * (a == "r") + 0.4 * (b == "v") + 0.05 * (x - 2000)
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    k = 1 + np.digitize(eta + rng.logistic(size=n), [-0.6, 0.9])
    return spark.createDataFrame([(str(i), str(a[i]), str(b[i]), float(x[i]), int(y[i]), int(k[i])) for i in range(n)], "row_key string, a string, b string, x double, y int, k int").repartition(6)


@pytest.mark.parametrize("features", [["a", "b"], ["a", "b", "x"]])
def test_fits_equal_a_plain_newton(frame, features):
    spec = fit_design(frame, features, ["a", "b"])
    pdf = spec.encode(frame, keep=["y", "k"]).toPandas()
    X = pdf[spec.terms].to_numpy(float)
    m = logit_mle(frame, spec, "y")
    b, cov = _plain(X, pdf["y"].to_numpy(float))
    assert m.converged and not m.separated
    assert np.allclose(m.coef, b, atol=1e-8) and np.allclose(m.cov, cov, rtol=1e-6)
    o = ordered_logit(frame, spec, "k", [1, 2, 3])
    want = _plain_ordered(X, pdf["k"].to_numpy() - 1, 3) if "x" not in features else None
    if want is not None:
        assert np.allclose(np.concatenate((o.cuts, o.beta)), want, atol=1e-6)
    assert o.converged and np.all(np.diff(o.cuts) > 0)


def test_level_designs_are_fitted_on_patterns(frame):
    spec = fit_design(frame, ["a", "b"], ["a", "b"])
    rows, grouped = NW.problem_rows(frame, spec, F.col("y"))
    assert grouped and rows.count() <= 3 * 2 * 2 and rows.agg(F.sum("w")).first()[0] == frame.count()
    assert not NW.problem_rows(frame, fit_design(frame, ["a", "x"], ["a"]), F.col("y"))[1]


def test_models_share_their_passes(spark, frame, monkeypatch):
    passes = []
    real = NW._pass
    monkeypatch.setattr(NW, "_pass", lambda s, ps: passes.append(len(ps)) or real(s, ps))
    specs = [fit_design(frame, f, ["a", "b"]) for f in (["a"], ["a", "b"], ["a", "b", "x"])]
    problems = [NW.binary_problem(frame, s, "y") for s in specs] + [NW.ordered_problem(frame, specs[1], "k", [1, 2, 3])]
    NW.solve(spark, problems)
    together = len(passes)
    assert all(p.converged for p in problems)
    assert together == max(p.iterations for p in problems) + 1 and passes[0] == 4
    alone = logit_mle(frame, specs[2], "y")
    assert np.allclose(problems[2].at, alone.coef, atol=1e-10)


def test_separated_term_goes_over_to_l1(spark):
    rng = np.random.default_rng(2)
    rows = [("s", 1)] * 300 + [("t", int(v)) for v in rng.random(700) < 0.4] + [("u", int(v)) for v in rng.random(700) < 0.6]
    df = spark.createDataFrame(rows, "c string, y int")
    spec = fit_design(df, ["c"], ["c"], drop_first=False)
    m = logit_mle(df, spec, "y")
    assert m.separated and not m.converged
    l1 = logit_or_l1(df, spec, "y")
    assert l1.fit_type == "Regularized (L1)" and abs(l1.coef[0]) < 15
    fine = df.where("c <> 's'")
    assert logit_or_l1(fine, fit_design(fine, ["c"], ["c"], drop_first=False), "y").fit_type == "MLE"


def test_separation_by_a_combination_of_terms(spark):
    """No level decides the outcome alone, two together do."""
    rows = [(a, b, y) for a, b, y, n in (("p", "u", 0, 50), ("q", "u", 1, 40), ("p", "v", 1, 40), ("q", "v", 1, 40), ("q", "u", 0, 0)) for _ in range(n)]
    df = spark.createDataFrame(rows, "a string, b string, y int")
    m = logit_mle(df, fit_design(df, ["a", "b"], ["a", "b"]), "y", fit_intercept=True)
    assert m.separated and not m.converged


def test_almost_equal_columns_are_no_duplicates(spark):
    """20,000 rows, ten of which differ by 0.01 at 1,000: kept; an equal one, also with -0.0, is found."""
    df = spark.range(20000).select((F.rand(5) * 100 + 1000).alias("a"), "id", F.lit(1).alias("y")).withColumn("b", F.when(F.col("id") < 10, F.col("a") + 0.01).otherwise(F.col("a"))) \
        .withColumn("c", F.col("a") + 0.0).withColumn("z", F.lit(0.0)).withColumn("w", F.lit(-0.0))
    cols = ["a", "b", "c", "z", "w"]
    _, prints = column_summary(df, cols)
    assert equal_columns(df, cols, prints, [F.lit(True)]) == [{"a": "a", "b": "b", "c": "a", "z": "z", "w": "z"}]
    # columns of one fingerprint that are not equal are told apart by value
    assert equal_columns(df, ["a", "b", "c"], [[1, 1, 1]], [F.lit(True)]) == [{"a": "a", "b": "b", "c": "a"}]
    pruned = prune_design(fit_design(df, ["a", "b", "c"], []), df, None)
    assert pruned.terms == ["a", "b"] and pruned.dropped == {"c": "duplicate"}


def test_rank_on_the_datas_own_scale(spark):
    """Columns that differ by 1e-7 of their length are independent; the sum of two is not."""
    df = spark.range(5000).select((F.rand(1) + 1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("e")) \
        .withColumn("near", F.col("a") + 1e-7 * F.col("e")).withColumn("sum", F.col("a") + F.col("b")).withColumn("zero", F.lit(0.0)).repartition(7)
    cols = ["a", "near", "b", "sum", "zero"]
    factors, _ = column_summary(df, cols)
    assert [cols[j] for j in independent_columns(factors[0])] == ["a", "near", "b"]
    pdf = df.toPandas()[cols].to_numpy()
    assert np.allclose(factors[0].T @ factors[0], pdf.T @ pdf, rtol=1e-12)


def test_empty_group_has_a_zero_factor(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (3.0, 4.0, 0)], "a double, b double, g int")
    factors, prints = column_summary(df, ["a", "b"], "g", 2)
    assert np.allclose(factors[1], 0) and prints[1] == [0, 0] and independent_columns(factors[0]) == [0, 1]


def test_wide_scenarios_equal_narrow_ones(frame, monkeypatch):
    """The matrix form of the scenario means is the expression form, also with missing numbers in the population."""
    from riskloom.operators import whatif as WI
    model = logit_mle(frame, fit_design(frame, ["a", "b", "x"], ["a", "b"]), "y")
    pop = frame.withColumn("x", F.when(F.col("row_key") % 7 != 0, F.col("x")))
    overrides = [{}, {"a": "r"}, {"x": 1990.0}, {"a": "q", "x": 2010.0}]
    narrow = WI.scenario_averages(pop, model, overrides).first().asDict()
    monkeypatch.setattr(WI, "EXPRESSION_TERMS", 0)
    wide = WI.scenario_averages(pop, model, overrides).first().asDict()
    assert narrow.keys() == wide.keys() and all(np.isclose(narrow[k], wide[k], rtol=1e-10) for k in narrow)


def test_rows_are_packed_and_unpacked(frame):
    """A row holds its numbers and one level number a categorical column, not one number a term; unpacked it is the encoded matrix."""
    odd = frame.withColumn("a", F.when(F.col("row_key") % 5 != 0, F.col("a"))).withColumn("b", F.when(F.col("row_key") % 7 == 0, F.lit("new")).otherwise(F.col("b")))
    spec = fit_design(frame, ["a", "b", "x"], ["a", "b"], drop_first=False)
    spec = spec.with_terms([*spec.terms, "a_q"])     # a repeated term
    x, packing = spec.packed(intercept=True)
    rows = odd.select("row_key", x.alias("x")).orderBy("row_key").collect()
    assert len(rows[0].x) == packing.size == 4 < packing.width == 8
    wanted = np.array(spec.encode(odd, ["row_key"], spec.terms[:-1]).orderBy("row_key").drop("row_key").collect())
    found = packing.unpacked(np.array([r.x for r in rows]))
    assert np.array_equal(found[:, :6], wanted) and np.array_equal(found[:, 6], wanted[:, spec.terms.index("a_q")]) and (found[:, 7] == 1).all()
    assert len(NW.problem_rows(frame, fit_design(frame, ["a", "b", "x"], ["a", "b"]), F.col("y"))[0].first().x) == 3


def test_one_pass_gives_the_statistics_too(frame):
    """Counts, variation and fingerprints of the packed pass are those of the encoded columns, also with missing outcomes and levels."""
    rows = frame.select("row_key", "x", F.when(F.col("row_key") % 6 != 0, F.col("a")).alias("a"), "b", F.when(F.col("row_key") % 9 != 0, F.col("y")).alias("y"),
                        (F.col("row_key") % 3 == 0).cast("int").alias("t"), F.lit(1.0).alias("one"), (F.col("row_key") % 2).cast("double").alias("flag")).cache()
    spec = fit_design(rows, ["x", "one", "flag", "a", "b"], ["a", "b"], drop_first=False)
    enc = rows.select("y", "t", *[spec.term_expr(t).alias(t) for t in spec.terms])
    x, packing = spec.packed()
    found = summaries(rows.select(x.alias("x"), F.col("t").alias("g"), F.coalesce(F.col("y") == 1, F.lit(False)).alias("y")), packing, spec.terms, 3)
    wanted = term_stats(enc, spec.terms, "y", "t", 3, spec)
    assert [stats_of(s, spec.terms, spec) for s in found] == wanted
    factors, prints = column_summary(enc, spec.terms, "t", 3)
    for s, factor, p in zip(found, factors, prints):
        assert np.allclose(s.factor.T @ s.factor, factor.T @ factor, rtol=1e-12) and s.prints.tolist() == p


def test_report_without_a_sample_needs_no_keys(frame):
    """Without a sample no row key is read (it was kept with every row), and the fit is the same."""
    from riskloom.plans import suites as SU
    from riskloom.presets import HygieneSpec
    spec = HygieneSpec(categorical=["a", "b"], default_threshold=1)
    def report(df):
        return SU.what_if_report(df.sparkSession, df, SU.ModelSpec("m", ["x", "a", "b"], ["a", "b"]), "y", spec, baseline_defaults={"a": "p"}, switch_scenarios=[("q", "a", "q")],
                                 risk_profile_list=[("r", {"a": "r"})], contrast=("a", [("q", "q"), ("r", "r")]), curves=[("x", [1990.0, 2010.0])])
    assert np.isfinite(report(frame.drop("row_key"))["curve_x"].first()["Predicted_Probability"])
