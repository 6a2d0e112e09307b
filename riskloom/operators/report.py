"""Report-table shapes: top-k, ordering, tornado, profile unpivot, error bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import format_value, variable_label


def top_k(df: DataFrame, col: str, n: int, largest: bool = True, tie: str | None = None) -> DataFrame:
    """The n largest (or smallest) rows by ``col`` (TakeOrderedAndProject)."""
    key = F.desc(col) if largest else F.asc(col)
    return df.orderBy(key, *([F.asc(tie)] if tie else [])).limit(n)


def top_by_abs(terms: DataFrame, col: str = "Coefficient", n: int = 20, tie: str = "Term") -> DataFrame:
    """Non-zero values ordered by absolute size, top n."""
    return terms.filter(F.col(col) != 0).orderBy(F.abs(F.col(col)).desc(), F.asc(tie)).limit(n)


def nonzero_count(terms: DataFrame, col: str = "Coefficient") -> DataFrame:
    return terms.agg(F.count_if(F.col(col) != 0).alias("n_nonzero"), F.count(F.lit(1)).alias("n_terms"))


def ordered_category_sort(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Order rows by a fixed category order (unknown categories last)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col))
    return df.orderBy(F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1)), F.asc(col))


def metric_ranking(df: DataFrame, metric: str) -> DataFrame:
    return df.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), F.asc("Model"))


def tornado_table(switch: DataFrame, baseline_name: str) -> DataFrame:
    """Scenarios except the baseline, by absolute change, with its sign."""
    return (switch.filter(F.col("Scenario") != F.lit(baseline_name))
            .select("Scenario", "Variable", "Absolute_Change",
                    F.signum("Absolute_Change").cast("int").alias("Direction"))
            .orderBy(F.asc("Absolute_Change"), F.asc("Scenario")))


def error_bar_widths(df: DataFrame, label_col: str) -> DataFrame:
    p = F.col("Predicted_Probability")
    return df.select(label_col, p, (p - F.col("CI_Lower_95")).alias("Lower_Error"),
                     (F.col("CI_Upper_95") - p).alias("Upper_Error"))


def profile_unpivot(profile: DataFrame, features: list[str], categorical: list[str],
                    variable_labels: dict[str, str], value_labels: dict[str, dict[str, str]]) -> DataFrame:
    """One wide profile row -> (Order, Feature, Value) display rows."""
    pairs = F.array(*[F.struct(
        F.lit(i).alias("Order"), F.lit(c).alias("variable"),
        (F.col(c).cast("string") if c in categorical else F.lit(None).cast("string")).alias("text"),
        (F.lit(None).cast("double") if c in categorical else F.col(c).cast("double")).alias("number"))
        for i, c in enumerate(features)])
    long = profile.select(F.inline(pairs))
    return long.select("Order", variable_label(F.col("variable"), variable_labels).alias("Feature"),
                       format_value(F.col("variable"), F.col("text"), F.col("number"), value_labels).alias("Value"))


def with_position(df: DataFrame) -> DataFrame:
    """Number the rows of a small ordered report table from 1, in the order they come in."""
    return df.coalesce(1).withColumn("Position", F.monotonically_increasing_id() + 1)
