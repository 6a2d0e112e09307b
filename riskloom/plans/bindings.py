"""Bindings of the operators to the test tables.

* ``prepared_records`` - the record table with labels and derived columns.
* ``scored_documents`` - an imbalanced labelled table with a score in 0..1.
* ``FIXED_LOGIT`` / ``FIXED_ORDINAL`` - models with literal coefficients, so
  scoring, intervals and what-if tables can be checked in plain SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalar import null_out_of_range
from riskloom.operators.design import DesignSpec
from riskloom.operators.fit import LogitModel
from riskloom.operators.ordinal import OrderedModel
from riskloom.sources.tables import read_table, records

STATUS_CLASS = {"F": 1, "O": 2, "P": 3}


def prepared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records plus labels: ``y`` (status O/P), ``y_ord`` (F<O<P) and ``ship_lag``
    (ship year - order year, kept only inside 0..60)."""
    r = records(spark, sf_dir)
    y_ord = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in STATUS_CLASS.items()])
    lag = (F.col("ship_year") - F.col("order_year")).cast("double")
    return r.select("*", F.col("o_orderstatus").isin("O", "P").cast("int").alias("y"),
                    y_ord.alias("y_ord"), null_out_of_range(lag, 0.0, 60.0).alias("ship_lag"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels x documents: y = quality, score = n_chars / max(n_chars) (lazy scalar subquery)."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    mx = j.agg(F.max("n_chars")).scalar()
    return j.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") / mx).alias("p"))


# ---- literal models (fixed values for the SQL-checkable scoring queries) ----

FIXED_FEATURES = ["l_quantity", "l_discount", "p_size", "c_acctbal",
                  "l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment", "p_type"]
FIXED_CATEGORICAL = ["l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment", "p_type"]
FIXED_TERMS = [
    ("l_quantity", "l_quantity", None, 0.004),
    ("l_discount", "l_discount", None, -0.8),
    ("p_size", "p_size", None, 0.003),
    ("c_acctbal", "c_acctbal", None, 0.00002),
    ("l_returnflag_N", "l_returnflag", "N", 0.05),
    ("l_returnflag_R", "l_returnflag", "R", -0.04),
    ("l_linestatus_O", "l_linestatus", "O", 0.6),
    ("o_orderpriority_2-HIGH", "o_orderpriority", "2-HIGH", 0.1),
    ("o_orderpriority_3-MEDIUM", "o_orderpriority", "3-MEDIUM", -0.1),
    ("c_mktsegment_BUILDING", "c_mktsegment", "BUILDING", 0.08),
    ("p_type_ECONOMY", "p_type", "ECONOMY", -0.07),
    ("p_type_LARGE", "p_type", "LARGE", 0.12),
]


def _fixed_spec() -> DesignSpec:
    levels = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"],
              "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
              "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
              "p_type": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]}
    return DesignSpec(FIXED_FEATURES, ["l_quantity", "l_discount", "p_size", "c_acctbal"], levels,
                      [t for t, _, _, _ in FIXED_TERMS], {t: (c, lv) for t, c, lv, _ in FIXED_TERMS})


def _fixed_cov(sd: list[float], rho: float = 0.1) -> np.ndarray:
    """Covariance with the given standard errors and correlation rho^|i-j| (positive definite)."""
    p = len(sd)
    r = np.array([[rho ** abs(i - j) for j in range(p)] for i in range(p)])
    s = np.asarray(sd)
    return r * np.outer(s, s)


FIXED_SE = [0.0005, 0.3, 0.0007, 0.000003, 0.02, 0.02, 0.02, 0.03, 0.03, 0.03, 0.035, 0.035]

FIXED_LOGIT = LogitModel(
    spec=_fixed_spec(),
    coef=np.array([c for _, _, _, c in FIXED_TERMS]),
    cov=_fixed_cov(FIXED_SE),
    intercept=0.0,
    fit_type="Fixed",
    se=np.array(FIXED_SE),
)

FIXED_ORDINAL = OrderedModel(
    spec=DesignSpec(FIXED_FEATURES, ["l_quantity", "l_discount", "p_size", "c_acctbal"], _fixed_spec().levels,
                    ["l_quantity", "l_linestatus_O", "p_type_LARGE"],
                    {"l_quantity": ("l_quantity", None), "l_linestatus_O": ("l_linestatus", "O"),
                     "p_type_LARGE": ("p_type", "LARGE")}),
    classes=[1, 2, 3],
    cuts=np.array([-0.6, 0.8]),
    beta=np.array([0.0123, 0.517, -0.2071]),
    converged=True,
)
