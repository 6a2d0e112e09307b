"""Model pipelines composed from the operators (binary, ordinal, exploratory, what-if).

Every step is a Spark job over the whole prepared table. The models of a suite
keep their common source and their split rows as tables of the shared folder, some bytes a row,
and give them back at the end; the other pipelines cache their prepared frame (MEMORY_AND_DISK).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import evaluate as EV
from riskloom.operators import hygiene as HY
from riskloom.operators import profile as PR
from riskloom.operators import whatif as WI
from riskloom.operators.design import DesignSpec, fit_design, prune_design
from riskloom.operators import newton as NW
from riskloom.operators.fit import LogitModel, fit_report, logit_l1, logit_or_l1, mle_model, odds_ratios, term_table
from riskloom.operators.ordinal import OrderedModel, class_probabilities, ordered_model, ordered_predict, ordinal_term_table
from riskloom.operators.report import top_by_abs
from riskloom.operators.sampling import sample_n, stratified_split, with_hash
from riskloom.operators.score import batch_score, score_with_interval
from riskloom.presets import HygieneSpec
from riskloom.session import at_once, checkpointed, kept, release

#: The columns of a row's hash (``with_hash``).
HASH = ["_hk", "_h"]


@dataclass
class ModelSpec:
    """One model of a suite: features, roles and preparation rules."""

    label: str
    features: list[str]
    categorical: list[str]
    impute: list[str] = field(default_factory=list)     # numeric columns imputed with a flag
    default_threshold: int | None = None


@dataclass
class BinaryResult:
    label: str
    model: LogitModel
    metrics: DataFrame


@dataclass
class OrdinalResult:
    label: str
    model: OrderedModel
    metrics: DataFrame | None


def prepare_binary(df: DataFrame, m: ModelSpec, y_col: str, hygiene: HygieneSpec, include_other: bool):
    """Reference order: drop missing (non-imputed features) -> impute with flags ->
    collapse + rare grouping (one counting pass) -> optional OTHER-row removal."""
    required = [c for c in m.features if c not in m.impute] + [y_col]
    d = HY.drop_missing(df, required)
    imp = HY.fit_median_imputer(d, m.impute)
    d = imp.apply(d)
    d, _ = HY.variablewise_preprocess(d, hygiene, m.categorical, include_other_group=include_other,
                                      default_threshold=m.default_threshold)
    return d, m.features + imp.flag_columns


def _keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def prepare_split_design(df: DataFrame, m: ModelSpec, y_col: str, hygiene: HygieneSpec, *,
                         include_other: bool, seed: int = 42, test_share: float = 0.30,
                         key_col: str | None = "row_key", sparse: bool = True, cache_source: bool = True):
    """Prepared, split and kept model table plus its pruned design.

    The source projection is kept first, so the hygiene, imputation and split
    jobs read it once from the scan; the split table, which has no key any more, is kept for the fit.
    Without ``key_col`` the rows have their hash already. Returns (table, spec, [kept frames to release]).
    """
    order = [key_col] if key_col else HASH
    cols = list(dict.fromkeys([*order, y_col] + m.features))
    src = kept(df.select(cols), give_back=True) if cache_source else df.select(cols)
    d, feats = prepare_binary(src, m, y_col, hygiene, include_other)
    keep = list(dict.fromkeys([y_col] + feats))
    d = kept(stratified_split(d.select(list(dict.fromkeys([*order, *keep]))), y_col, test_share, seed, key_col).select(*keep, "is_test"))
    spec = fit_design(d, feats, m.categorical)
    spec = prune_design(spec, d, y_col if sparse else None, split_col="is_test", sparse=sparse)
    return d, spec, [d, src] if cache_source else [d]


@dataclass
class Prepared:
    """A model ready to fit: its prepared, split and kept rows, its pruned design and its Newton problem."""

    label: str
    rows: DataFrame
    spec: DesignSpec
    y_col: str
    problem: NW.Problem
    cached: list[DataFrame]
    classes: list[int] | None = None    # of an ordered model

    @property
    def test(self) -> DataFrame:
        return self.rows.filter(F.col("is_test") == 1).select(self.y_col, *[c for c in self.spec.features if c in self.rows.columns])


def prepare_binary_model(df: DataFrame, m: ModelSpec, y_col: str, hygiene: HygieneSpec, *, include_other: bool, seed: int = 42,
                         test_share: float = 0.30, key_col: str | None = "row_key", cache_source: bool = True) -> Prepared:
    d, spec, cached = prepare_split_design(df, m, y_col, hygiene, include_other=include_other, seed=seed, test_share=test_share, key_col=key_col, cache_source=cache_source)
    if not spec.terms:
        release(cached)
        raise ValueError(f"no terms left to fit in {m.label}")
    return Prepared(m.label, d, spec, y_col, NW.binary_problem(d.filter(F.col("is_test") == 0), spec, y_col), cached)


def prepare_ordinal_model(df: DataFrame, m: ModelSpec, y_col: str, hygiene: HygieneSpec, *, include_other: bool, classes=(1, 2, 3), seed: int = 42,
                          test_share: float = 0.30, key_col: str | None = "row_key", max_iter: int = 50, cache_source: bool = True) -> Prepared:
    """Ordinal path: coerce class and numerics, filter classes, drop missing, hygiene, encode, split.

    Classes and numeric features may be text; what is no number counts as missing.
    """
    numeric = [c for c in m.features if c not in m.categorical]
    order = [key_col] if key_col else HASH
    typed = df.select(list(dict.fromkeys([*order, y_col] + m.features))).withColumns({c: HY.as_number(df, c) for c in [y_col, *numeric]})
    src = typed.filter(F.col(y_col).isin([float(c) for c in classes])).withColumn(y_col, F.col(y_col).cast("int"))
    src = kept(src, give_back=True) if cache_source else src
    d = HY.drop_missing(src, m.features + [y_col])
    if d.isEmpty():
        release([src] if cache_source else [])
        raise ValueError(f"no rows left: {y_col} has no class of {list(classes)} in a row without missing features")
    d, _ = HY.variablewise_preprocess(d, hygiene, m.categorical, include_other_group=include_other,
                                      default_threshold=m.default_threshold)
    keep = list(dict.fromkeys([y_col] + m.features))
    d = kept(stratified_split(d.select(list(dict.fromkeys([*order, *keep]))), y_col, test_share, seed, key_col).select(*keep, "is_test"))
    spec = fit_design(d, m.features, m.categorical)
    spec = prune_design(spec, d, None, split_col="is_test", sparse=False, rank=False)
    problem = NW.ordered_problem(d.filter(F.col("is_test") == 0), spec, y_col, sorted(classes), max_iter)
    return Prepared(m.label, d, spec, y_col, problem, [d, src] if cache_source else [d], sorted(classes))


def binary_result(p: Prepared) -> BinaryResult:
    """The fitted model of a solved problem and its metrics on the test rows (one row, kept)."""
    model = mle_model(p.problem, p.spec)
    scored = batch_score(p.test, model)
    return BinaryResult(p.label, model, checkpointed(EV.evaluate_binary(scored, p.y_col, "Predicted_Probability", 0.5, p.label)))


def ordinal_result(p: Prepared) -> OrdinalResult:
    model = ordered_model(p.problem, p.spec, p.classes)
    # the predictions are counted once, by class, prediction and probabilities
    probs = [f"p_{c}" for c in model.classes]
    pred = ordered_predict(p.test, model).select(p.y_col, "predicted", *probs)
    cells = pred.groupBy(F.col(p.y_col).cast("bigint").alias("actual"), F.col("predicted").cast("bigint").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    auc = EV.roc_auc_ovr_macro(pred, p.y_col, dict(zip(model.classes, probs))).select("ROC_AUC").scalar()
    return OrdinalResult(p.label, model, checkpointed(EV.metrics_row(cells, p.label, auc)))


def fit_suite(spark: SparkSession, prepared: list[Prepared]) -> list[BinaryResult | OrdinalResult]:
    """Fit all models in shared data passes, evaluate each, and let their rows go."""
    try:
        NW.solve(spark, [p.problem for p in prepared])
        return at_once(spark, [partial(ordinal_result if p.classes else binary_result, p) for p in prepared])
    finally:
        release([f for p in prepared for f in p.cached])


def _fitted(spark: SparkSession, source: DataFrame, prepare: list[Callable[[], Prepared]]) -> list[BinaryResult | OrdinalResult]:
    """``fit_suite`` of the models that ``prepare`` makes of a kept source, several at a time."""
    try:
        return fit_suite(spark, at_once(spark, prepare))
    finally:
        release([source])


VARIANTS = (("with_other_group", True), ("without_other_group", False))


def _needed(df: DataFrame, models: list[ModelSpec], *y_cols: str, key_col: str = "row_key", seed: int = 42, **_) -> DataFrame:
    """The columns that the models read, kept; the key's hash, which all splits go by, is made once and takes its place."""
    columns = list(dict.fromkeys([*y_cols] + [c for m in models for c in m.features]))
    return kept(with_hash(df.select(list(dict.fromkeys([key_col, *columns]))), seed, key_col).select(*HASH, *columns), give_back=True)


def _variants(models: list[ModelSpec], variants) -> list[tuple[ModelSpec, bool]]:
    return [(ModelSpec(f"{m.label} ({name})", m.features, m.categorical, m.impute, m.default_threshold), inc) for name, inc in variants for m in models]


def _stacked(results) -> DataFrame:
    table = results[0].metrics
    for r in results[1:]:
        table = table.unionByName(r.metrics)
    return table


def fit_binary(spark: SparkSession, df: DataFrame, m: ModelSpec, y_col: str, hygiene: HygieneSpec, *,
               include_other: bool, **kw) -> BinaryResult:
    return fit_suite(spark, [prepare_binary_model(df, m, y_col, hygiene, include_other=include_other, **kw)])[0]


def fit_ordinal(spark: SparkSession, df: DataFrame, m: ModelSpec, y_col: str, hygiene: HygieneSpec, *,
                include_other: bool, evaluate: bool = True, **kw) -> OrdinalResult:
    p = prepare_ordinal_model(df, m, y_col, hygiene, include_other=include_other, **kw)
    if evaluate:
        return fit_suite(spark, [p])[0]
    try:
        NW.solve(spark, [p.problem])
        return OrdinalResult(m.label, ordered_model(p.problem, p.spec, p.classes), None)
    finally:
        release(p.cached)


def binary_suite(spark: SparkSession, df: DataFrame, models: list[ModelSpec], y_col: str,
                 hygiene: HygieneSpec, variants=VARIANTS, **kw) -> tuple[DataFrame, list[BinaryResult]]:
    """Each model under each hygiene variant, all fitted in the same passes; one comparison table."""
    df = _needed(df, models, y_col, **kw)
    kw = {**kw, "cache_source": False, "key_col": None}
    results = _fitted(spark, df, [partial(prepare_binary_model, df, m, y_col, hygiene, include_other=inc, **kw) for m, inc in _variants(models, variants)])
    return EV.comparison_table(_stacked(results)), results


def ordinal_suite(spark: SparkSession, df: DataFrame, models: list[ModelSpec], y_col: str, hygiene: HygieneSpec,
                  variants=VARIANTS, **kw) -> tuple[DataFrame, list[OrdinalResult]]:
    df = _needed(df, models, y_col, **kw)
    kw = {**kw, "cache_source": False, "key_col": None}
    results = _fitted(spark, df, [partial(prepare_ordinal_model, df, m, y_col, hygiene, include_other=inc, **kw) for m, inc in _variants(models, variants)])
    return EV.comparison_table(_stacked(results)), results


def model_comparison(spark: SparkSession, df: DataFrame, binary_models: list[ModelSpec], y_bin: str,
                     ordinal_models: list[ModelSpec], y_ord: str, hygiene: HygieneSpec,
                     sample: int | None = None, seed: int = 42) -> DataFrame:
    """Binary and ordinal models on one shared (optionally sampled) table, fitted in the same passes; one sorted table."""
    base = df.filter(F.col(y_ord).cast("int").isin(1, 2, 3))
    if sample:
        base = sample_n(base, sample, seed)
    base = _needed(base, [*binary_models, *ordinal_models], y_bin, y_ord)
    kw = {"cache_source": False, "key_col": None}
    results = _fitted(spark, base, [partial(prepare_binary_model, base, m, y_bin, hygiene, include_other=inc, **kw) for m, inc in _variants(binary_models, VARIANTS)]
                      + [partial(prepare_ordinal_model, base, m, y_ord, hygiene, include_other=inc, **kw) for m, inc in _variants(ordinal_models, VARIANTS)])
    n = len(binary_models) * len(VARIANTS)
    binary, ordinal = EV.comparison_table(_stacked(results[:n])), EV.comparison_table(_stacked(results[n:]))
    return EV.sort_results(EV.standardize_metrics(binary, "Binary Logit").unionByName(EV.standardize_metrics(ordinal, "Ordinal Logit")))


def exploratory(spark: SparkSession, df: DataFrame, m: ModelSpec, y_col: str, *, alpha: float = 0.1,
                min_count: int | None = None, min_share: float | None = None, seed: int = 42,
                key_col: str = "row_key") -> dict[str, DataFrame]:
    """L1 logit without special-code collapsing (rare levels -> RARE), evaluated at
    0.5 and at the threshold that maximises balanced accuracy on the test rows."""
    src = _keep(df.select(list(dict.fromkeys([key_col, y_col] + m.features))))
    d = HY.drop_missing(src, m.features + [y_col])
    rule = HY.fit_rare_levels(d, m.categorical, min_count=min_count or 3000,
                              shares={c: min_share for c in m.categorical} if min_share else None,
                              other_label="RARE")
    d = rule.apply(d)
    keep = list(dict.fromkeys([key_col, y_col] + m.features))
    d = stratified_split(d.select(keep), y_col, 0.30, seed, key_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        spec = fit_design(d, m.features, m.categorical)
        spec = prune_design(spec, d, None, split_col="is_test", sparse=False, rank=False)
        train = d.filter(F.col("is_test") == 0)
        test = d.filter(F.col("is_test") == 1)
        model = logit_l1(train, spec, y_col, alpha=alpha)
        scored = batch_score(test.select(y_col, *spec.features), model).select(y_col, "Predicted_Probability")
        scored = checkpointed(scored)
        best = EV.threshold_sweep(scored, y_col, "Predicted_Probability").first()
        both = EV.evaluate_at(scored, y_col, "Predicted_Probability", [(f"{m.label} (0.50)", 0.5), (f"{m.label} (tuned)", float(best["best_threshold"]))])
        terms = term_table(spark, model)
        out = {"metrics": checkpointed(both.orderBy("Model")),
               "top_coefficients": top_by_abs(terms, "Coefficient", 20),
               "fit": fit_report(spark, model, m.label)}
    finally:
        release([d, src])
    return out


def what_if_report(spark: SparkSession, df: DataFrame, m: ModelSpec, y_col: str, hygiene: HygieneSpec, *,
                   baseline_defaults: dict, switch_scenarios: list, risk_profile_list: list, contrast: tuple,
                   curves: list[tuple[str, list]], sample: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Fit the combined model on all prepared rows (rows with missing numerics dropped),
    then score the baseline profile and every scenario table with intervals."""
    # the key is for drawing the sample; without one it would only be kept
    src = _keep(df.select(*(["row_key"] if sample else []), y_col, *m.features))
    d = HY.drop_missing(src, m.features + [y_col])
    d, _ = HY.variablewise_preprocess(d, hygiene, m.categorical, include_other_group=True,
                                      default_threshold=m.default_threshold)
    if sample:
        d = sample_n(d, sample, seed)
    d = _keep(d)
    try:
        spec = prune_design(fit_design(d, m.features, m.categorical), d, y_col)
        model = logit_or_l1(d, spec, y_col)
        baseline = checkpointed(PR.baseline_profile(d, m.features, m.categorical, baseline_defaults))
        out = {
            "baseline_profile": score_with_interval(baseline, model),
            "category_switch": WI.what_if_switch(baseline, model, switch_scenarios),
            "group_contrast": WI.group_contrast(baseline, model, contrast),
            "risk_profiles": WI.risk_profiles(baseline, model, risk_profile_list),
            "odds_ratios": odds_ratios(term_table(spark, model)),
            "fit": fit_report(spark, model, m.label),
        }
        for var, grid in curves:
            out[f"curve_{var}"] = WI.what_if_curve(baseline, model, var, grid)
        # every table says which fit it comes from
        out = {k: checkpointed(v if "Fit_Type" in v.columns else v.withColumn("Fit_Type", F.lit(model.fit_type))) for k, v in out.items()}
    finally:
        release([d, src])
    out["model"] = model  # type: ignore[assignment]
    return out


__all__ = ["ModelSpec", "binary_suite", "ordinal_suite", "model_comparison", "exploratory", "what_if_report",
           "fit_binary", "fit_ordinal", "DesignSpec", "class_probabilities", "ordinal_term_table"]
