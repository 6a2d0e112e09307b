"""Categorical hygiene, level statistics, imputation and row filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import coerce_numeric, nan_to_null
from riskloom.operators.ranks import exact_quantiles
from riskloom.presets import DEFAULT_KEEP_LEVELS, DEFAULT_SPECIAL_LEVELS, HygieneSpec
from riskloom.session import stored


def collapse_special_levels(df: DataFrame, cols: list[str], levels: list[str] | None = None,
                            other_label: str = "OTHER") -> DataFrame:
    """Codes in ``levels`` become ``other_label``; NULL stays NULL; values become text."""
    lv = list(DEFAULT_SPECIAL_LEVELS if levels is None else levels)
    repl = {c: F.when(F.col(c).cast("string").isin(lv), F.lit(other_label))
            .otherwise(F.col(c).cast("string")) for c in cols}
    return df.withColumns(repl)


def level_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, level, count) for every listed column in ONE aggregation pass.

    NULL levels are counted as their own group (level NULL).
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"))
                      for c in cols])
    return (df.select(F.inline(pairs))
            .groupBy("variable", "level")
            .agg(F.count(F.lit(1)).alias("count")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Level counts including NULL, with the share among non-missing rows."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    non_missing = df.filter(F.col(col).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return counts.withColumn(
        "share", F.when(F.col(col).isNotNull(), F.try_divide(F.col("count"), non_missing)))


@dataclass
class RareRule:
    """Fitted rare-level rule: a (variable, level) table of what to replace, and the label.

    The table stays on the cluster and is joined, so a column may have any
    number of rare levels; the planner broadcasts it while it is small.
    """

    columns: list[str]
    rare: DataFrame | None = None
    other_label: str = "RARE"

    def apply(self, df: DataFrame) -> DataFrame:
        if self.rare is None:
            return df
        out = df.withColumns({c: F.col(c).cast("string") for c in self.columns})
        for i, c in enumerate(self.columns):
            lv = f"_rare_level_{i}"
            levels = self.rare.filter(F.col("variable") == c).select(F.col("level").alias(lv))
            out = (out.join(levels, F.col(c) == F.col(lv), "left")
                   .withColumn(c, F.when(F.col(lv).isNotNull(), F.lit(self.other_label)).otherwise(F.col(c)))
                   .drop(lv))
        return out


def _threshold_column(spec_thresholds: dict[str, int], spec_shares: dict[str, float],
                      default: int, cols: list[str]) -> Column:
    """Per-variable min count as a column expression over (variable, total)."""
    expr = F.lit(float(default))
    for c in cols:
        if c in spec_shares:
            expr = F.when(F.col("variable") == c, F.col("_total") * F.lit(float(spec_shares[c]))).otherwise(expr)
        elif c in spec_thresholds:
            expr = F.when(F.col("variable") == c, F.lit(float(spec_thresholds[c]))).otherwise(expr)
    return expr


def fit_rare_levels(df: DataFrame, cols: list[str], *, min_count: int = 3000,
                    thresholds: dict[str, int] | None = None, shares: dict[str, float] | None = None,
                    keep_levels: dict[str, list[str]] | list[str] | None = None,
                    other_label: str = "RARE") -> RareRule:
    """Count all columns in one pass and pick, per column, levels with
    count < threshold (strict), not in the keep set and not missing."""
    if not cols:
        return RareRule([], None, other_label)
    thresholds = thresholds or {}
    shares = shares or {}
    counts = level_counts(df, cols)
    totals = counts.groupBy("variable").agg(F.sum("count").alias("_total"))
    counts = counts.join(totals, "variable")
    counts = counts.withColumn("_min", _threshold_column(thresholds, shares, min_count, cols))
    if isinstance(keep_levels, dict):
        keep_map = {c: list(keep_levels.get(c, DEFAULT_KEEP_LEVELS)) for c in cols}
    else:
        keep = list(DEFAULT_KEEP_LEVELS if keep_levels is None else keep_levels)
        keep_map = {c: keep for c in cols}
    keep_expr = F.lit(False)
    for c in cols:
        keep_expr = F.when(F.col("variable") == c, F.col("level").isin(keep_map[c])).otherwise(keep_expr)
    rare = counts.filter(F.col("level").isNotNull() & (F.col("count") < F.col("_min")) & ~keep_expr)
    # counted once; a table in the shared folder feeds all the joins, broadcast if it is small
    return RareRule(list(cols), stored(rare.select("variable", "level")), other_label)


def group_rare_levels(df: DataFrame, col: str, min_count: int = 3000, other_label: str = "RARE",
                      keep_levels: list[str] | None = None) -> DataFrame:
    """Single-column form: count < min_count (strict), not kept, not missing -> other_label."""
    return fit_rare_levels(df, [col], min_count=min_count, keep_levels=keep_levels,
                           other_label=other_label).apply(df)


def drop_other_rows(df: DataFrame, cols: list[str], other_label: str = "OTHER") -> DataFrame:
    """Remove rows where any listed column equals OTHER (NULL rows go too)."""
    if not cols:
        return df
    cond = None
    for c in cols:
        term = F.col(c) != F.lit(other_label)
        cond = term if cond is None else cond & term
    return df.filter(cond)


def variablewise_preprocess(df: DataFrame, spec: HygieneSpec, cols: list[str] | None = None, *,
                            include_other_group: bool = True,
                            default_threshold: int | None = None,
                            default_keep: list[str] | None = None) -> tuple[DataFrame, RareRule]:
    """Collapse special codes, group rare levels per column (one counting job for
    all columns, before any OTHER rows are removed), optionally drop OTHER rows."""
    cols = list(spec.categorical if cols is None else cols)
    keep_default = list(spec.default_keep if default_keep is None else default_keep)
    collapsed = collapse_special_levels(df, cols, spec.special_levels, spec.other_label)
    rule = fit_rare_levels(
        collapsed, cols,
        min_count=spec.default_threshold if default_threshold is None else default_threshold,
        thresholds={c: spec.rare_thresholds[c] for c in cols if c in spec.rare_thresholds},
        shares={c: spec.rare_shares[c] for c in cols if c in spec.rare_shares},
        keep_levels={c: list(spec.keep_levels.get(c, keep_default)) for c in cols},
        other_label=spec.other_label)
    out = rule.apply(collapsed)
    if not include_other_group:
        out = drop_other_rows(out, cols, spec.other_label)
    return out, rule


def level_outcome_rates(df: DataFrame, col: str, y_col: str, top_n: int | None = None) -> DataFrame:
    """Per level (NULL kept): row count and event rate, highest rate first; all levels unless ``top_n`` is given."""
    out = (df.groupBy(col)
           .agg(F.count(F.col(y_col)).alias("count"), F.avg(F.col(y_col).cast("double")).alias("event_rate"))
           .orderBy(F.desc("event_rate"), F.desc("count"), F.asc_nulls_first(col)))
    return out.limit(top_n) if top_n else out


def grouped_rates_multi(df: DataFrame, cols: list[str], y_col: str) -> DataFrame:
    """Level outcome rates for many columns in one aggregation (variable, level, count, event_rate)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"))
                      for c in cols])
    return (df.select(F.col(y_col).cast("double").alias("_y"), F.inline(pairs))
            .groupBy("variable", "level")
            .agg(F.count("_y").alias("count"), F.avg("_y").alias("event_rate")))


@dataclass
class Imputer:
    """Fitted median imputation: fill values and which columns get a missing flag."""

    fills: dict[str, float]
    flagged: list[str]
    suffix: str = "_MISSING"

    @property
    def flag_columns(self) -> list[str]:
        return [f"{c}{self.suffix}" for c in self.flagged]

    def apply(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c in self.flagged:
            cols[f"{c}{self.suffix}"] = as_number(df, c).isNull().cast("tinyint")
        for c, v in self.fills.items():
            cols[c] = F.coalesce(as_number(df, c), F.lit(float(v)))
        return df.withColumns(cols)


def as_number(df: DataFrame, c: str) -> Column:
    """Numeric view of a column: text is parsed, numbers cast, NaN -> NULL."""
    if df.schema[c].dataType.typeName() == "string":
        return coerce_numeric(c)
    return nan_to_null(F.col(c).cast("double"))


def fit_median_imputer(df: DataFrame, cols: list[str], suffix: str = "_MISSING") -> Imputer:
    """Exact medians (0.0 when a column is all missing) and missing flags, one pass each."""
    if not cols:
        return Imputer({}, [], suffix)
    numeric = df.select([as_number(df, c).alias(c) for c in cols])
    missing: dict[str, int] = {}
    med = exact_quantiles(numeric, cols, [0.5], missing=missing)   # one counting pass for both
    fills = {c: (0.0 if med[c][0] is None else float(med[c][0])) for c in cols}
    flagged = [c for c in cols if missing.get(c, 0) > 0]
    return Imputer(fills, flagged, suffix)


def impute_median(df: DataFrame, cols: list[str], suffix: str = "_MISSING") -> tuple[DataFrame, list[str]]:
    imp = fit_median_imputer(df, cols, suffix)
    return imp.apply(df), imp.flag_columns


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with NULL (or NaN) in any listed column."""
    return df.na.drop(subset=list(cols)) if cols else df
