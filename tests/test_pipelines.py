"""End-to-end model pipelines on the small tables (rows-only queries)."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskloom import presets as P
from riskloom import session
from riskloom.operators import newton as NW
from riskloom.operators import sampling as SA
from riskloom.operators.evaluate import threshold_grid
from riskloom.plans import suites as SU
from tests.conftest import SF_SMALL


def test_what_if_report_baseline_row_has_no_change(spark):
    rows = E.queries()["what_if_report"](spark, SF_SMALL).orderBy("Scenario_Order").collect()
    assert len(rows) == 6
    assert rows[0]["Absolute_Change"] == 0.0
    for r in rows:
        assert r["CI_Lower_95"] <= r["Predicted_Probability"] <= r["CI_Upper_95"]


def test_exploratory_uses_grid_threshold(spark):
    rows = E.queries()["exploratory_fatal"](spark, SF_SMALL).collect()
    assert [r["Threshold"] for r in rows][0] == 0.5
    assert any(np.isclose(rows[1]["Threshold"], t) for t in threshold_grid())


def test_ordered_pipeline_metrics_in_range(spark):
    r = E.queries()["ordered_pipeline"](spark, SF_SMALL).first()
    for k in ("Accuracy", "Balanced_Accuracy", "Macro_F1", "ROC_AUC"):
        assert 0.0 <= r[k] <= 1.0
    assert 0.0 <= r["MAE"] <= 2.0


def test_full_rank_columns_reports_every_candidate(spark):
    rows = E.queries()["full_rank_columns"](spark, SF_SMALL).collect()
    kept = [r for r in rows if r["Status"] == "kept"]
    assert kept and [r["Position"] for r in kept] == list(range(len(kept)))


def suite_rows(spark, n=900):
    rng = np.random.default_rng(4)
    rows = [(f"k{i}", int(rng.random() < 0.4), int(rng.integers(1, 4)), float(rng.normal()) if i % 9 else None, float(rng.integers(0, 50)), str(rng.choice(["a", "b", "c"]))) for i in range(n)]
    return spark.createDataFrame(rows, "row_key string, y int, o int, x double, z double, c string")


MODELS = [SU.ModelSpec("One", ["z", "c"], ["c"], default_threshold=1), SU.ModelSpec("Two", ["x", "z", "c"], ["c"], ["x"], default_threshold=1)]
ORDINAL = [SU.ModelSpec("Ordinal", ["z", "c"], ["c"], default_threshold=1)]


def test_suites_keep_narrow_tables_and_give_them_back(spark, monkeypatch):
    """No rows are cached; the key goes after its hash is made, the hash after the split; at the end all tables are empty."""
    tables, real = [], session.kept
    spy = lambda df, *a, **k: tables.append(real(df, *a, **k)) or tables[-1]
    monkeypatch.setattr(SU, "kept", spy)
    monkeypatch.setattr(NW, "kept", spy)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    table, results = SU.binary_suite(spark, suite_rows(spark), MODELS, "y", P.RECORDS)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
    assert [r.label for r in results] == [f"{m.label} ({v})" for v, _ in SU.VARIANTS for m in MODELS]
    assert sorted(t.columns for t in tables) == sorted([["_hk", "_h", "y", "z", "c", "x"], *[["y", "z", "c", "is_test"]] * 2, *[["y", "x", "z", "c", "x_MISSING", "is_test"]] * 2,
                                                        *[["k", "w", "x0", "x1"]] * 2, *[["k", "w", "x0", "x1", "x2", "x3"]] * 2])
    assert all(spark.read.parquet(t.kept_at).isEmpty() for t in tables)
    assert table.count() == 4


def test_models_of_a_suite_equal_those_fitted_alone(spark):
    df = suite_rows(spark)
    _, binary = SU.binary_suite(spark, df, MODELS, "y", P.RECORDS)
    _, ordinal = SU.ordinal_suite(spark, df, ORDINAL, "o", P.RECORDS)
    alone = [SU.fit_binary(spark, df, m, "y", P.RECORDS, include_other=True) for m in MODELS]
    for a, b in zip(alone, binary):
        assert a.model.terms == b.model.terms and np.allclose(a.model.coef, b.model.coef, atol=1e-9)
        assert a.metrics.drop("Model").first() == b.metrics.drop("Model").first()
    one = SU.fit_ordinal(spark, df, ORDINAL[0], "o", P.RECORDS, include_other=True)
    assert np.allclose(one.model.beta, ordinal[0].model.beta, atol=1e-9)


def test_models_are_prepared_several_at_a_time(spark, monkeypatch):
    """Two preparations wait for each other; one after the other they would not end."""
    met, real = threading.Barrier(2), SU.prepare_binary_model
    monkeypatch.setattr(SU, "prepare_binary_model", lambda *a, **k: met.wait(60) is not None and real(*a, **k))
    table = SU.model_comparison(spark, suite_rows(spark), MODELS[:1], "y", ORDINAL, "o", P.RECORDS)
    assert table.count() == 4


def test_an_error_in_one_task_is_raised_after_the_others(spark):
    done = []
    with pytest.raises(ZeroDivisionError):
        session.at_once(spark, [lambda: 1 / 0, lambda: time.sleep(0.5) or done.append(spark.range(3).count())])
    assert done == [3]
    assert session.at_once(spark, [lambda k=k: k for k in range(9)]) == list(range(9))


def test_a_split_by_a_hash_that_is_there(spark):
    df = suite_rows(spark).withColumn("row_key", F.when(F.col("z") > 3, F.col("row_key")))
    want = SA.stratified_split(df, "y", 0.3, 7).select("row_key", "is_test")
    got = SA.stratified_split(SA.with_hash(df, 7, "row_key"), "y", 0.3, 7, None).select("row_key", "is_test")
    assert sorted(want.collect(), key=str) == sorted(got.collect(), key=str)
