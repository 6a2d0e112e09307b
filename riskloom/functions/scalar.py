"""Column-expression helpers: all JVM-side, whole-stage-codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal or scientific number, optionally signed, surrounded by blanks.
# Spark's cast would also accept "1d"/"1f" suffixes, which a numeric parser rejects.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c: str | Column) -> Column:
    """Text -> double; anything that is not a number becomes NULL (never NaN)."""
    s = F.trim(_col(c).cast("string"))
    return F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))


def nan_to_null(c: str | Column) -> Column:
    x = _col(c)
    return F.when(~F.isnan(x), x)


def null_out_of_range(c: str | Column, lo: float, hi: float) -> Column:
    """Keep values inside [lo, hi]; everything else (and NaN) becomes NULL."""
    x = _col(c)
    return F.when(x.between(F.lit(lo), F.lit(hi)) & ~F.isnan(x), x)


def downcast(df: DataFrame) -> DataFrame:
    """double -> float, bigint -> int where all its values fit; other columns unchanged.

    One aggregation finds the range of every bigint column; one that does not
    fit keeps its type.
    """
    longs = [n for n, t in df.dtypes if t == "bigint"]
    fits: set[str] = set()
    if longs:
        row = df.agg(*[F.coalesce(F.min(n).between(-2**31, 2**31 - 1) & F.max(n).between(-2**31, 2**31 - 1), F.lit(True)).alias(n)
                       for n in longs]).first()
        fits = {n for n in longs if row[n]}
    types = {"double": "float"}
    return df.select([F.col(n).cast("int" if n in fits else types.get(t, t)).alias(n) for n, t in df.dtypes])


def normalize_code(c: str | Column) -> Column:
    """Trim; a numeric code becomes its integer text ("01" -> "1", "1.0" -> "1"); one beyond the
    bigint range stays as it is."""
    s = F.trim(_col(c).cast("string"))
    as_int = F.when(F.abs(s.try_cast("double")) < 2.0**63, s.try_cast("double")).try_cast("bigint").cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), F.coalesce(as_int, s)).otherwise(s)


def sigmoid(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def relative_change_percent(p: Column, base: Column) -> Column:
    """(p - base) / base * 100; NULL when base is 0."""
    return F.try_divide(p - base, base) * F.lit(100.0)


def round_numeric(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every float/double/decimal column; other columns unchanged."""
    numeric = {"double", "float"}
    return df.select([
        F.round(F.col(n), digits).alias(n) if (t in numeric or t.startswith("decimal")) else F.col(n)
        for n, t in df.dtypes
    ])


def format_number_text(x: Column) -> Column:
    """Whole numbers as integers, others with one decimal (display format)."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(
        F.format_string("%.1f", x))
