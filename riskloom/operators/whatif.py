"""What-if and bootstrap scoring of whole populations.

A scenario is a set of column overrides.  Every scenario is scored in the
same projection as the row's own (baseline) score, then averaged in one
aggregation: no cross join, no row multiplication.  A one-row population (a
baseline profile) reproduces the single-profile analysis exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalar import relative_change_percent, sigmoid
from riskloom.functions.sqltext import number
from riskloom.operators.fit import LogitModel
from riskloom.operators.profile import distribution_summary, risk_bands
from riskloom.operators.sampling import bootstrap_sample
from riskloom.operators.score import EXPRESSION_TERMS, linear_predictor, score_with_interval
from riskloom.presets import Z_PREDICTION_INTERVAL
from riskloom.session import checkpointed


def _common_value(c: str) -> Column:
    """The column's value if it is the same on every row, else NULL (as text)."""
    s = F.col(c).cast("string")
    return F.when(F.min(s) == F.max(s), F.min(s))


def _override_vector(model: LogitModel, ov: dict) -> tuple[set[int], np.ndarray]:
    """Indices of the terms an override set replaces, and their new (constant) values."""
    idx: set[int] = set()
    d = np.zeros(len(model.terms))
    for j, t in enumerate(model.terms):
        col, level = model.spec.source[t]
        if col in ov:
            idx.add(j)
            v = ov[col]
            d[j] = float(v) if level is None else (1.0 if str(v) == level else 0.0)
    return idx, d


def scenario_cross(profiles: DataFrame, scenarios: list[tuple]) -> DataFrame:
    """Every profile under every scenario (name, column, value or None for the baseline).

    Scenarios are few and given, so each row is expanded in place; a column that
    a scenario sets takes its value as text or number, as the column is.
    """
    kinds = {f.name: f.dataType for f in profiles.schema.fields}

    def under(name: str, var: str, value) -> Column:
        cells = [F.lit(value).cast(kinds[c]).alias(c) if c == var and value is not None else F.col(f"`{c}`").alias(c) for c in profiles.columns]
        return F.struct(F.lit(name).alias("Scenario"), *cells)

    return profiles.select(F.inline(F.array(*[under(*s) for s in scenarios])))


def scenario_means(pop: DataFrame, model: LogitModel, overrides: list[dict], with_ci: bool = True):
    """Per-row scenario scores, ready to average.

    A scenario replaces the terms S by constants d.  With r the row's term vector
    with S zeroed and u = Σr:
        eta' = eta - Σ_{j∈S} b_j x_j + b·d
        x'ᵀΣx' = rᵀΣr + 2 Σ_{j∈S} d_j u_j + dᵀΣd
    rᵀΣr and u_S depend only on S, so scenarios overriding the same columns (a
    whole curve) share them and each scenario costs O(|S|).  Every stage is a
    small expression, so the projection stays inside whole-stage codegen.
    """
    p = len(model.terms)
    b = np.asarray(model.coef, dtype="float64")
    cov = None if model.cov is None else np.asarray(model.cov, dtype="float64")
    names = [f"_x{j}" for j in range(p)]
    src = model.spec.source
    feats = [c for c in model.spec.features if c in pop.columns]
    stage = pop.select(*feats, *[model.spec.term_expr(t).alias(names[j]) for j, t in enumerate(model.terms)])
    eta_full = "(" + " + ".join([number(model.intercept)] +
                                [f"{number(c)} * {names[j]}" for j, c in enumerate(b) if c != 0.0]) + ")"

    def qform(skip: set[int]) -> str:
        parts = ["0.0D"]
        for j in range(p):
            if j in skip:
                continue
            for k in range(j, p):
                if k in skip or cov[j, k] == 0.0:
                    continue
                (cj, lj), (ck, lk) = src[model.terms[j]], src[model.terms[k]]
                if j != k and cj == ck and lj is not None and lk is not None:
                    continue
                w = cov[j, k] if j == k else 2.0 * cov[j, k]
                parts.append(f"{number(w)} * {names[j]}" + ("" if (j == k and lj is not None) else f" * {names[k]}"))
        return "(" + " + ".join(parts) + ")"

    # stage B: per distinct override set S -> eta_r, q_S, u_{S,j}
    sets: dict[frozenset, int] = {}
    plans = []
    for ov in overrides:
        skip, d = _override_vector(model, ov)
        key = frozenset(skip)
        if key not in sets:
            sets[key] = len(sets)
        plans.append((sets[key], skip, d))
    stage_b = [F.expr(eta_full).alias("_eta")]
    for key, k in sets.items():
        minus = " ".join(f"- {number(b[j])} * {names[j]}" for j in sorted(key) if b[j] != 0.0)
        stage_b.append(F.expr(f"({eta_full} {minus})").alias(f"_er{k}"))
        if with_ci and cov is not None:
            stage_b.append(F.expr(qform(set(key))).alias(f"_q{k}"))
            for j in sorted(key):
                row = " + ".join(["0.0D"] + [f"{number(cov[j, m])} * {names[m]}" for m in range(p)
                                             if m not in key and cov[j, m] != 0.0])
                stage_b.append(F.expr(f"({row})").alias(f"_u{k}_{j}"))
    staged = stage.select(*feats, *stage_b)

    # stage C: per scenario eta and variance
    stage_c = [F.col(c) for c in feats] + [F.expr("1.0D / (1.0D + exp(-_eta))").alias("pb")]
    for i, (k, skip, d) in enumerate(plans):
        stage_c.append(F.expr(f"_er{k} + {number(float(b @ d))}").alias(f"_e{i}"))
        if with_ci and cov is not None:
            lin = " + ".join(["0.0D"] + [f"{number(2.0 * d[j])} * _u{k}_{j}" for j in sorted(skip) if d[j] != 0.0])
            stage_c.append(F.expr(f"greatest(_q{k} + {lin} + {number(float(d @ cov @ d))}, 0.0D)").alias(f"_v{i}"))
    scored_c = staged.select(*stage_c)

    # stage D: probabilities and bounds
    z = number(Z_PREDICTION_INTERVAL)
    cols = [F.col(c) for c in feats] + [F.col("pb")]
    for i in range(len(plans)):
        cols.append(F.expr(f"1.0D / (1.0D + exp(-_e{i}))").alias(f"s{i}_Predicted_Probability"))
        if with_ci and cov is not None:
            cols.append(F.expr(f"1.0D / (1.0D + exp(-(_e{i} - {z} * sqrt(_v{i}))))").alias(f"s{i}_CI_Lower_95"))
            cols.append(F.expr(f"1.0D / (1.0D + exp(-(_e{i} + {z} * sqrt(_v{i}))))").alias(f"s{i}_CI_Upper_95"))
        else:
            cols += [F.lit(None).cast("double").alias(f"s{i}_CI_Lower_95"),
                     F.lit(None).cast("double").alias(f"s{i}_CI_Upper_95")]
    scored = scored_c.select(*cols)
    aggs = [F.avg("pb").alias("pb")]
    for i in range(len(overrides)):
        aggs += [F.avg(f"s{i}_{k}").alias(f"s{i}_{k}") for k in ("Predicted_Probability", "CI_Lower_95", "CI_Upper_95")]
    return scored, aggs


def scenario_averages(pop: DataFrame, model: LogitModel, overrides: list[dict]) -> DataFrame:
    """One row: the mean probability of the population (``pb``) and, per scenario i, of ``s<i>_`` probability and bounds.

    With a covariance the quadratic forms are matrix products on Arrow batches,
    and a task sends one vector of sums: as expressions they make a method that is
    too long to be compiled. Models without one are scored by expressions.
    """
    p = len(model.terms)
    if model.cov is None or p == 0:
        scored, aggs = scenario_means(pop, model, overrides)
        return scored.agg(*aggs)
    b, cov = np.asarray(model.coef, dtype="float64"), np.asarray(model.cov, dtype="float64")
    names, intercept, z = list(model.terms), float(model.intercept), float(Z_PREDICTION_INTERVAL)
    fixed = [(sorted(skip), d) for skip, d in (_override_vector(model, ov) for ov in overrides)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros(1 + 3 * len(fixed)), 0
        for batch in batches:
            X = np.column_stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype="float64") for i in range(p)]).reshape(batch.num_rows, p)
            # a row with a missing number has no score and is in no mean
            gone = np.isnan(X).any(axis=1) if p > EXPRESSION_TERMS else np.any([batch.column(i).is_null().to_numpy(zero_copy_only=False) for i in range(p)], axis=0)
            X = X[~gone]
            out = [_sigmoid(X @ b + intercept)]
            for skip, d in fixed:
                Y = X.copy()
                Y[:, skip] = d[skip]
                eta = np.where(np.isnan(X).any(axis=1), np.nan, Y @ b + intercept)
                half = z * np.sqrt(np.clip(((Y @ cov) * Y).sum(axis=1), 0.0, None))
                out += [_sigmoid(eta), _sigmoid(eta - half), _sigmoid(eta + half)]
            sums += [v.sum() for v in out]
            count += len(X)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(sums, count)], pa.list_(pa.float64()))], names=["s"])

    fan_in = max(1, math.isqrt(int(pop.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = model.spec.encode(pop).mapInArrow(fold, "s array<double>").select(array_to_vector("s").alias("v")).repartition(fan_in)
    one = parts.agg(Summarizer.sum(F.col("v")).alias("t")).select(vector_to_array("t").alias("t"))
    n = 1 + 3 * len(fixed)
    mean = [F.try_divide(F.get("t", F.lit(i)), F.get("t", F.lit(n))) for i in range(n)]
    cells = [mean[0].alias("pb")]
    for i in range(len(fixed)):
        cells += [mean[1 + 3 * i + k].alias(f"s{i}_{name}") for k, name in enumerate(("Predicted_Probability", "CI_Lower_95", "CI_Upper_95"))]
    return one.select(*cells)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700.0, 700.0)))


def what_if_switch(pop: DataFrame, model: LogitModel, scenarios: list[tuple]) -> DataFrame:
    """Switch one column per scenario; probability, interval and change vs the baseline."""
    overrides = [({} if v is None else {var: v}) for _, var, v in scenarios]
    means = scenario_averages(pop, model, overrides)
    variables = sorted({var for _, var, _ in scenarios})
    # text min/max needs a sort-based aggregate: keep it out of the numeric pass
    common = pop.agg(*[_common_value(v).alias(f"base_{v}") for v in variables])
    arr = common.select(F.array(*[F.col(f"base_{v}") for v in variables])).scalar()
    one = means.select("*", *[arr[i].alias(f"base_{v}") for i, v in enumerate(variables)])
    rows = []
    for i, (name, var, value) in enumerate(scenarios):
        p = F.col(f"s{i}_Predicted_Probability")
        base_val = F.col(f"base_{var}")
        scen_val = base_val if value is None else F.lit(str(value))
        rows.append(F.struct(
            F.lit(i).alias("Scenario_Order"), F.lit(name).alias("Scenario"), F.lit(var).alias("Variable"),
            base_val.alias("Baseline_Value"), scen_val.alias("Scenario_Value"),
            p.alias("Predicted_Probability"), F.col(f"s{i}_CI_Lower_95").alias("CI_Lower_95"),
            F.col(f"s{i}_CI_Upper_95").alias("CI_Upper_95"),
            (p - F.col("pb")).alias("Absolute_Change"),
            relative_change_percent(p, F.col("pb")).alias("Relative_Change_Percent")))
    return one.select(F.inline(F.array(*rows)))


def what_if_curve(pop: DataFrame, model: LogitModel, variable: str, values: list) -> DataFrame:
    """Vary one numeric column over a grid; mean probability and interval per value."""
    overrides = [{variable: float(v)} for v in values]
    means = scenario_averages(pop, model, overrides)
    one = means
    rows = [F.struct(F.lit(variable).alias("Variable"), F.lit(float(v)).alias("Value"),
                     F.col(f"s{i}_Predicted_Probability").alias("Predicted_Probability"),
                     F.col(f"s{i}_CI_Lower_95").alias("CI_Lower_95"),
                     F.col(f"s{i}_CI_Upper_95").alias("CI_Upper_95"))
            for i, v in enumerate(values)]
    return one.select(F.inline(F.array(*rows)))


def risk_profiles(pop: DataFrame, model: LogitModel, profiles: list[tuple]) -> DataFrame:
    """Named bundles of overrides, ordered by probability (lowest first)."""
    overrides = [dict(ov) for _, ov in profiles]
    means = scenario_averages(pop, model, overrides)
    one = means
    rows = [F.struct(F.lit(name).alias("Profile"),
                     F.col(f"s{i}_Predicted_Probability").alias("Predicted_Probability"),
                     F.col(f"s{i}_CI_Lower_95").alias("CI_Lower_95"),
                     F.col(f"s{i}_CI_Upper_95").alias("CI_Upper_95"))
            for i, (name, _) in enumerate(profiles)]
    return one.select(F.inline(F.array(*rows))).orderBy("Predicted_Probability", "Profile")


def group_contrast(pop: DataFrame, model: LogitModel, contrast: tuple) -> DataFrame:
    """Compare values of one column; changes are relative to the first value."""
    var, cases = contrast
    ref_value = cases[0][1]
    overrides = [{var: v} for _, v in cases]
    means = scenario_averages(pop, model, overrides)
    one = means
    p0 = F.col("s0_Predicted_Probability")
    rows = []
    for i, (name, v) in enumerate(cases):
        p = F.col(f"s{i}_Predicted_Probability")
        rows.append(F.struct(F.lit(name).alias("Scenario"), F.lit(str(v)).alias(var), p.alias("Predicted_Probability"),
                             F.col(f"s{i}_CI_Lower_95").alias("CI_Lower_95"),
                             F.col(f"s{i}_CI_Upper_95").alias("CI_Upper_95"),
                             (p - p0).alias(f"Absolute_Change_vs_{ref_value}"),
                             relative_change_percent(p, p0).alias(f"Relative_Change_Percent_vs_{ref_value}")))
    return one.select(F.inline(F.array(*rows)))


def bootstrap_risk(spark: SparkSession, pop: DataFrame, model: LogitModel, baseline: DataFrame, *,
                   n_draws: int = 5000, seed: int = 42, key_col: str = "row_key",
                   fit_type: str | None = None) -> dict[str, DataFrame]:
    """Resample rows with replacement, score them, summarise and band the scores.

    Draws are never refit: this resamples inputs, not the model.
    """
    feats = [c for c in model.spec.features if c in pop.columns]
    draws = bootstrap_sample(spark, pop.select(key_col, *feats), n_draws, seed, key_col)
    scored = draws.select("draw_id", *feats, sigmoid(linear_predictor(model)).alias("Predicted_Probability"),
                          F.lit(None).cast("double").alias("CI_Lower_95"),
                          F.lit(None).cast("double").alias("CI_Upper_95"),
                          F.lit(fit_type or model.fit_type).alias("Fit_Type"))
    # the draws feed several summaries: write them once to the checkpoint folder
    # (reliable, lineage cut) instead of re-running the indexing join per summary
    scored = checkpointed(scored)
    base = score_with_interval(baseline, model).select("Predicted_Probability", "CI_Lower_95", "CI_Upper_95")
    base_arr = base.select(F.array("Predicted_Probability", "CI_Lower_95", "CI_Upper_95")).scalar()
    summary = distribution_summary(scored, "Predicted_Probability").select(
        "*", base_arr[0].alias("Baseline_Probability"), base_arr[1].alias("Baseline_CI_Lower_95"),
        base_arr[2].alias("Baseline_CI_Upper_95"))
    bands = risk_bands(scored, "Predicted_Probability")
    return {"draws": scored, "summary": summary, "bands": bands}


def brief_details(baseline: DataFrame, summary: DataFrame, bands: DataFrame, profile_cols: list[str]) -> DataFrame:
    """Four text lines from the baseline, the summary and the risk bands."""
    prof = baseline.select(F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
                                               for c in profile_cols])).scalar()
    s = summary.select(F.struct("*")).scalar()
    high = bands.filter(F.col("Risk_Band") == "0.75 and above").select("Share").scalar()
    lines = [
        F.concat(F.lit("Baseline profile: "), prof),
        F.format_string("Baseline predicted probability: %.4f (95%% CI %.4f to %.4f)",
                        s["Baseline_Probability"], s["Baseline_CI_Lower_95"], s["Baseline_CI_Upper_95"]),
        F.format_string("Monte Carlo central range: 5th percentile %.4f, median %.4f, 95th percentile %.4f",
                        s["p05_probability"], s["median_probability"], s["p95_probability"]),
        F.format_string("High-risk draws (>= 0.75): %.1f%%", high * F.lit(100.0)),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("Line"), t.alias("Text")) for i, t in enumerate(lines)])
    return summary.sparkSession.range(1).select(F.inline(rows))
