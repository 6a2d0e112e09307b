"""The collision preset on a made-up table of its layout: cleaning, suites, what-if tables and labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import presets as P
from riskloom.functions import labels as LB
from riskloom.functions.scalar import coerce_numeric, null_out_of_range
from riskloom.operators import sampling as SA
from riskloom.plans import suites as SU

N = 6000


@pytest.fixture(scope="module")
def raw(spark):
    """Codes with special and rare ones, numbers as text with ``UU`` among them, two outcomes that follow the codes."""
    rng = np.random.default_rng(31)
    pick = {c: [*keep[:4], "UU" if len(keep[0]) == 2 else "U", keep[4] if len(keep) > 5 else keep[0]] for c, keep in P.COLLISION_KEEP_LEVELS.items() if c != "P_SEX"}
    share = [0.45, 0.25, 0.15, 0.1, 0.03, 0.02]
    cols = {c: rng.choice(v, N, p=share) for c, v in pick.items()}
    cols["P_SEX"] = rng.choice(["F", "M", "U"], N, p=[0.5, 0.47, 0.03])
    age = rng.integers(16, 90, N)
    risk = 0.8 * (cols["P_SAFE"] == "02") + 0.6 * (cols["C_WTHR"] == "2") + 0.02 * (age - 40)
    level = 1 + np.digitize(risk + rng.logistic(size=N), [-0.3, 1.5])
    numbers = {"P_AGE": age, "C_MNTH": rng.integers(1, 13, N), "C_WDAY": rng.integers(1, 8, N), "C_HOUR": rng.integers(0, 24, N), "C_VEHS": rng.integers(1, 5, N),
               "V_YEAR": rng.integers(1975, 2015, N), "P_ISEV": level, "C_SEV": rng.integers(1, 3, N)}
    text = {c: np.where(rng.random(N) < 0.02, "UU", np.char.mod("%02d", v)) for c, v in numbers.items()}
    names = [*cols, *text]
    rows = [(f"r{i}", 1999 + i % 16, *[str(cols[c][i]) for c in cols], *[str(text[c][i]) for c in text]) for i in range(N)]
    return spark.createDataFrame(rows, "row_key string, C_YEAR int, " + ", ".join(f"{c} string" for c in names))


@pytest.fixture(scope="module")
def clean(raw):
    typed = raw.withColumns({c: coerce_numeric(c) for c in P.NUMERIC_RAW_COLUMNS})
    age = null_out_of_range((F.col("C_YEAR") - F.col("V_YEAR")).cast("double"), *P.VEHICLE_AGE_RANGE)
    return typed.withColumn("VEHICLE_AGE", age).where(F.col("P_ISEV").isin(1, 2, 3)).withColumn("Y_INJURY", F.col("P_ISEV").isin(2, 3).cast("int"))


def test_cleaning(raw, clean):
    assert raw.where(F.col("P_AGE") == "UU").count() > 50 and clean.where(F.col("P_AGE").isNull()).count() > 50
    ages = clean.agg(F.min("VEHICLE_AGE"), F.max("VEHICLE_AGE"), F.count_if(F.col("VEHICLE_AGE").isNull())).first()
    assert ages[0] >= 0 and ages[1] <= 60 and ages[2] > 50


def test_comparison(spark, clean):
    binary = [SU.ModelSpec("RQ1", P.RQ1_FEATURES, P.RQ1_CATEGORICAL), SU.ModelSpec("RQ2", P.RQ2_FEATURES, P.RQ2_CATEGORICAL, P.RQ2_NUMERIC),
              SU.ModelSpec("Combined", P.COMBINED_FEATURES, P.COMBINED_CATEGORICAL, P.RQ2_NUMERIC, P.MIN_COUNT_RARE)]
    ordinal = [SU.ModelSpec(n, f, [c for c in f if c not in numeric]) for n, f, numeric in (("Ordinal RQ1", P.ORDINAL_RQ1_FEATURES, P.ORDINAL_RQ1_NUMERIC),
                                                                                          ("Ordinal RQ2", P.ORDINAL_RQ2_FEATURES, P.ORDINAL_RQ2_NUMERIC))]
    table = SU.model_comparison(spark, clean, binary, "Y_INJURY", ordinal, "P_ISEV", P.COLLISION, sample=min(P.N_SAMPLE_MAIN, P.PERSON_MODEL_SAMPLE_N, 5000), seed=P.RANDOM_STATE).collect()
    assert table[0].asDict().keys() == set(P.COMPARISON_COLUMNS) and len(table) == 10
    auc = {r.Model: r.ROC_AUC for r in table}
    assert auc["RQ2 (with_other_group)"] > 0.6 > 0.5 < auc["Combined (with_other_group)"] and [r.ROC_AUC for r in table] == sorted(auc.values(), reverse=True)
    assert {r.Family for r in table} == {"Binary Logit", "Ordinal Logit"}


def test_what_if_tables(spark, clean):
    m = SU.ModelSpec("Combined", P.COMBINED_FEATURES, P.COMBINED_CATEGORICAL)
    out = SU.what_if_report(spark, clean, m, "Y_INJURY", P.COLLISION, baseline_defaults=P.DEFAULT_BASELINE_PROFILE, switch_scenarios=P.COLLISION_SWITCH_SCENARIOS,
                            risk_profile_list=P.COLLISION_RISK_PROFILES, contrast=P.COLLISION_CONTRAST, curves=[("VEHICLE_AGE", P.VEHICLE_AGE_GRID), ("P_AGE", P.PERSON_AGE_GRID)])
    base = out["baseline_profile"].first()
    assert all(str(base[c]) == str(v) for c, v in P.DEFAULT_BASELINE_PROFILE.items())
    switch = out["category_switch"].orderBy("Scenario_Order").collect()
    assert [r.Scenario for r in switch] == [s[0] for s in P.COLLISION_SWITCH_SCENARIOS] and switch[0].Absolute_Change == 0 and {r.Fit_Type for r in switch} == {"MLE"}
    assert all(r.CI_Lower_95 <= r.Predicted_Probability <= r.CI_Upper_95 for r in switch)
    curve = [r.Predicted_Probability for r in out["curve_P_AGE"].orderBy("Value").collect()]
    assert len(curve) == len(P.PERSON_AGE_GRID) and curve == sorted(curve)
    assert out["risk_profiles"].count() == 3 and out["group_contrast"].count() == 2 and out["odds_ratios"].count() == len(out["model"].terms)
    # labels of the report
    shown = LB.scenario_label(F.col("Scenario"), F.col("Variable"), F.col("Scenario_Value"), variable_labels=P.VARIABLE_LABELS, value_labels=P.VALUE_LABELS,
                              scenario_labels=P.SCENARIO_VALUE_LABELS, baseline_name=P.BASELINE_SCENARIO_NAME, baseline_label=P.BASELINE_SCENARIO_LABEL)
    names = [r.shown for r in out["category_switch"].orderBy("Scenario_Order").select(shown.alias("shown")).collect()]
    assert names[0] == P.BASELINE_SCENARIO_LABEL and all(":" in n for n in names[1:])
    terms = out["odds_ratios"].select(F.col("Term").alias("term")).distinct()
    variables = spark.createDataFrame(list(P.VARIABLE_LABELS.items()), "variable string, variable_label string")
    overrides = spark.createDataFrame(list(P.TERM_LABEL_OVERRIDES.items()), "term string, override string")
    got = {r.term: r.label for r in LB.term_labels(terms, variables, LB.label_table(spark, P.VALUE_LABELS), overrides).collect()}
    assert set(got) == set(out["model"].terms) and all(v and not v.startswith(("C_", "P_", "V_")) for v in got.values())


def test_draws_and_split_of_the_preset(clean):
    """The test share and the number of draws are those of the analysis."""
    split = SA.stratified_split(clean, "Y_INJURY", P.TEST_SHARE, P.RANDOM_STATE).groupBy("Y_INJURY").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()
    assert all(r.t == -(-r.n * 3 // 10) for r in split)
    assert SA.bootstrap_sample(clean.sparkSession, clean, P.N_BOOTSTRAP_DRAWS).count() == P.N_BOOTSTRAP_DRAWS
    assert set(P.SEX_LABELS) >= {"F", "M"}
