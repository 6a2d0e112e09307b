"""Distribution summaries, risk bands, histograms, baseline profiles, column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.hygiene import as_number, level_counts
from riskloom.operators.ranks import quantiles_frame
from riskloom.presets import RISK_BANDS

SUMMARY_QUANTILES = [("median_probability", 0.5), ("p05_probability", 0.05), ("p25_probability", 0.25),
                     ("p75_probability", 0.75), ("p95_probability", 0.95)]


def distribution_summary(df: DataFrame, col: str) -> DataFrame:
    """n, mean, exact median, sample std, min, p05, p25, p75, p95, max as one row."""
    qs = quantiles_frame(df, [col], [p for _, p in SUMMARY_QUANTILES], [n for n, _ in SUMMARY_QUANTILES])
    qarr = qs.select(F.array(*[F.col(n) for n, _ in SUMMARY_QUANTILES])).scalar()
    x = F.col(col).cast("double")
    basic = df.agg(F.count(x).alias("n_draws"), F.avg(x).alias("mean_probability"),
                   F.stddev_samp(x).alias("std_probability"), F.min(x).alias("min_probability"),
                   F.max(x).alias("max_probability"))
    q = {n: qarr[i] for i, (n, _) in enumerate(SUMMARY_QUANTILES)}
    return basic.select("n_draws", "mean_probability", q["median_probability"].alias("median_probability"),
                        "std_probability", "min_probability",
                        q["p05_probability"].alias("p05_probability"), q["p25_probability"].alias("p25_probability"),
                        q["p75_probability"].alias("p75_probability"), q["p95_probability"].alias("p95_probability"),
                        "max_probability")


def risk_bands(df: DataFrame, col: str, bands=RISK_BANDS) -> DataFrame:
    """Count and share per half-open band, empty bands kept, in band order (one pass)."""
    x = F.col(col).cast("double")
    conds = []
    for _, lo, hi in bands:
        c = F.lit(True)
        if lo is not None:
            c = c & (x >= F.lit(float(lo)))
        if hi is not None:
            c = c & (x < F.lit(float(hi)))
        conds.append(c)
    agg = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(c).alias(f"_b{i}") for i, c in enumerate(conds)])
    rows = F.array(*[F.struct(F.lit(i).alias("Band_Order"), F.lit(label).alias("Risk_Band"),
                              F.col(f"_b{i}").alias("Count"),
                              F.try_divide(F.col(f"_b{i}").cast("double"), F.col("_total")).alias("Share"))
                     for i, (label, _, _) in enumerate(bands)])
    return agg.select(F.inline(rows))


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), zero bins kept."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo = rng.select("lo").scalar()
    hi = rng.select("hi").scalar()
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(1)).otherwise(F.least(F.width_bucket(x, lo, hi, F.lit(bins)), F.lit(bins)))
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", (lo + (F.col("bin") - 1) * width).alias("bin_lower"),
                    (lo + F.col("bin") * width).alias("bin_upper"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-missing level per column (ties -> lowest level): (variable, mode)."""
    counts = level_counts(df, cols).filter(F.col("level").isNotNull())
    w = Window.partitionBy("variable").orderBy(F.desc("count"), F.asc("level"))
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "variable", F.col("level").alias("mode"))


def baseline_profile(df: DataFrame, features: list[str], categorical: list[str],
                     defaults: dict | None = None) -> DataFrame:
    """One row over ``features``: the default if given, else mode (categorical)
    or exact median (numeric)."""
    defaults = defaults or {}
    need_cat = [c for c in features if c not in defaults and c in categorical]
    need_num = [c for c in features if c not in defaults and c not in categorical]
    mode_arr = med_arr = None
    if need_cat:
        m = modes(df, need_cat)
        mode_arr = m.agg(F.map_from_entries(F.collect_list(F.struct("variable", "mode")))).scalar()
    if need_num:
        numeric = df.select([as_number(df, c).alias(c) for c in need_num])
        q = quantiles_frame(numeric, need_num, [0.5], ["median"])
        med_arr = q.agg(F.map_from_entries(F.collect_list(F.struct("variable", "median")))).scalar()
    cols = []
    for c in features:
        if c in defaults:
            v = defaults[c]
            cols.append((F.lit(str(v)) if c in categorical else F.lit(float(v))).alias(c))
        elif c in categorical:
            cols.append(mode_arr[F.lit(c)].alias(c))
        else:
            cols.append(med_arr[F.lit(c)].alias(c))
    return df.sparkSession.range(1).select(cols)


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: does it hold more than one distinct value, NULL counted as a value.

    Needs only min, max and NULL counts (no distinct aggregation).
    """
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.count_if(x.isNull()).alias(f"{c}__nulls"), F.count(x).alias(f"{c}__nonnull")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(c).alias("variable"),
        ((F.col(f"{c}__min") != F.col(f"{c}__max"))
         | ((F.col(f"{c}__nulls") > 0) & (F.col(f"{c}__nonnull") > 0))).alias("varies"))
        for c in cols])
    return one.select(F.inline(rows))
