"""Cases that once went wrong: wide level lists, overflow, NULLs, repeated keys, order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import session
from riskloom.functions.scalar import downcast, normalize_code
from riskloom.operators import evaluate as EV
from riskloom.operators import hygiene as HY
from riskloom.operators import report as RP
from riskloom.operators import sampling as SA
from riskloom.operators.design import fit_design
from riskloom.operators.fit import logit_mle
from riskloom.operators.linalg import gram_matrix
from riskloom.operators.score import score_with_interval
from riskloom.plans import suites as SU
from riskloom.presets import HygieneSpec


def test_rare_grouping_with_twenty_thousand_levels(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 40_000, F.concat(F.lit("r"), F.col("id") % 20_000)).otherwise(F.lit("big")).alias("c"))
    out = HY.group_rare_levels(df, "c", min_count=10, other_label="RARE").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in out} == {"RARE": 40_000, "big": 20_000}


def test_level_outcome_rates_returns_all_levels(spark):
    df = spark.range(300).select((F.col("id") % 30).cast("string").alias("c"), (F.col("id") % 2).alias("y"))
    assert HY.level_outcome_rates(df, "c", "y").count() == 30


def test_checkpoint_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_downcast_keeps_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 3_000_000_000, 1.5), (2, None, None)], "a bigint, b bigint, c double")
    out = downcast(df)
    assert dict(out.dtypes) == {"a": "int", "b": "bigint", "c": "float"}
    assert [r["b"] for r in out.collect()] == [3_000_000_000, None]


def test_normalize_code_beyond_bigint(spark):
    df = spark.createDataFrame([("01",), ("123456789012345678901",), ("1e30",), (" 2.0 ",), ("U",), (None,)], "c string")
    assert [r[0] for r in df.select(normalize_code("c")).collect()] == ["1", "123456789012345678901", "1e30", "2", "U", None]


def test_null_in_gram_is_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double")
    with pytest.raises(Exception, match="missing or non-finite values in \\['a'\\]"):
        gram_matrix(df, ["a", "b"])


def test_intercept_is_part_of_the_covariance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(3.0, 1.0, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * x - 2.0)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    m = logit_mle(df, fit_design(df, ["x"], []), "y", fit_intercept=True)
    p = 1 / (1 + np.exp(-(m.coef[0] * x + m.intercept)))
    X = np.column_stack([x, np.ones(len(x))])
    cov = np.linalg.inv(X.T @ (X * (p * (1 - p))[:, None]))
    assert np.isclose(m.se[0], np.sqrt(cov[0, 0]), rtol=1e-6)
    row = score_with_interval(df.limit(1), m).first()
    v = np.array([row["x"], 1.0])
    eta = m.coef[0] * row["x"] + m.intercept
    assert np.isclose(row["CI_Lower_95"], 1 / (1 + np.exp(-(eta - 1.96 * np.sqrt(v @ cov @ v)))), atol=1e-4)


def test_split_counts_null_labels_as_a_class(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("row_key"), F.when(F.col("id") < 20, F.col("id") % 2).alias("y"))
    out = {r["y"]: r["n"] for r in SA.stratified_split(df, "y").groupBy("y").agg(F.sum("is_test").alias("n")).collect()}
    assert out == {0: 3, 1: 3, None: 3}


def test_draws_are_exact_with_repeated_keys(spark):
    df = spark.range(400).select((F.col("id") % 7).cast("string").alias("row_key"), "id")
    for n in (1, 51, 200, 399, 400, 500):
        assert SA.sample_n(df, n).count() == min(n, 400)
    assert SA.bootstrap_sample(spark, df, 50).count() == 50
    assert SA.stratified_split(df, "row_key").agg(F.sum("is_test")).first()[0] == sum(-(-n * 3 // 10) for n in [58, 57, 57, 57, 57, 57, 57])


def test_score_without_value_is_refused(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, None)], "y int, p double")
    with pytest.raises(Exception, match="has no p"):
        EV.evaluate_binary(df, "y", "p").collect()


def test_confusion_matrix_has_empty_cells(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (None, 1)], "a int, b int")
    cm = EV.confusion_matrix(df, "a", "b")
    assert sorted(map(tuple, cm.collect())) == [(1, 1, 1), (1, 3, 1), (3, 1, 0), (3, 3, 0)]
    assert EV.matrix_text(cm).first()[0] == "[[1, 1], [0, 0]]"


def test_order_of_report_tables(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.9), ("c", None), ("d", 0.5)], "Model string, ROC_AUC double").withColumn("Accuracy", F.lit(0.5))
    out = RP.with_position(EV.sort_results(df.repartition(3))).orderBy("Position").collect()
    assert [r["Model"] for r in out] == ["b", "d", "a", "c"] and [r["Position"] for r in out] == [1, 2, 3, 4]
    bands = spark.createDataFrame([("z",), ("low",), ("high",)], "b string").repartition(3)
    assert [r["b"] for r in RP.with_position(RP.ordered_category_sort(bands, "b", ["low", "high"])).orderBy("Position").collect()] == ["low", "high", "z"]


def test_ordinal_fit_takes_classes_and_numbers_as_text(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=900)
    k = 1 + (x + rng.logistic(size=900) > -0.5) + (x + rng.logistic(size=900) > 1.0)
    rows = [(str(i), f"{a:.4f}" if i % 50 else "UUUU", str(int(b)) if i % 31 else "U", "ab"[i % 2]) for i, (a, b) in enumerate(zip(x, k))]
    df = spark.createDataFrame(rows, "row_key string, x string, k string, c string")
    spec = HygieneSpec(categorical=["c"], default_threshold=1)
    res = SU.fit_ordinal(spark, df, SU.ModelSpec("m", ["x", "c"], ["c"]), "k", spec, include_other=True)
    assert res.model.converged and res.model.beta[0] > 0.3
    assert res.metrics.first()["Confusion_Matrix"].startswith("[[")
    with pytest.raises(ValueError, match="no rows left"):
        SU.fit_ordinal(spark, df.withColumn("k", F.lit("U")), SU.ModelSpec("m", ["x", "c"], ["c"]), "k", spec, include_other=True)
