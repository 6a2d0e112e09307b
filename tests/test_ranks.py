"""Radix selection, AUC states and hashed cut-offs against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate as EV
from riskloom.operators import ranks as RK
from riskloom.operators import sampling as SA


def test_quantiles_equal_numpy(spark):
    """Continuous, negative, repeated, missing and infinite values; one value; none; columns with odd names."""
    rng = np.random.default_rng(4)
    n = 5000
    cols = {"a b": rng.normal(size=n) * 1e-3, "neg": -rng.gamma(2.0, size=n) * 1e6, "ints": rng.integers(-20, 20, n).astype(float), "zero": np.where(rng.random(n) < 0.5, -0.0, 0.0),
            "wide": rng.choice([1e-300, -1e300, 3.0, 3.0000000000000004, -2.5, np.nan], n)}
    rows = [tuple(float(v[i]) for v in cols.values()) + (None, 7.0 if i == 3 else None) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols) + ", none double, one double").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 0.999, 1.0]
    missing, sizes = {}, {}
    got = RK.exact_quantiles(df, [*cols, "none", "one"], probs, missing, sizes)
    for c, v in cols.items():
        v = v[~np.isnan(v)]
        assert np.allclose(got[c], np.quantile(v, probs), rtol=1e-14, atol=0) and (missing[c], sizes[c]) == (n - len(v), len(v))
    assert got["none"] == [None] * 7 and missing["none"] == n and got["one"] == [7.0] * 7
    frame = {r.variable: r for r in RK.quantiles_frame(df, ["ints", "none"], [0.5], ["median"]).collect()}
    assert set(frame) == {"ints"} and frame["ints"].n == n
    assert RK.exact_quantiles(df.limit(0), ["ints"], [0.5]) == {"ints": [None]}


def test_auc_of_many_parts_and_ties(spark):
    rng = np.random.default_rng(9)
    y, s = rng.integers(0, 2, 3000), np.round(rng.random(3000), 2)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double").repartition(9)
    assert np.isclose(EV.roc_auc(df, "y", "s").first().ROC_AUC, want, rtol=1e-13)
    assert EV.roc_auc(df.where("y = 1"), "y", "s").first().ROC_AUC is None
    assert EV.roc_auc(df.limit(0), "y", "s").collect()[0].ROC_AUC is None
    macro = EV.roc_auc_ovr_macro(df.withColumn("t", 1 - F.col("s")), "y", {1: "s", 0: "t"}).first().ROC_AUC
    assert np.isclose(macro, want, rtol=1e-13)


def test_metrics_of_three_classes(spark):
    pairs = [(1, 1)] * 5 + [(1, 2)] * 2 + [(2, 2)] * 7 + [(3, 1)] * 3 + [(2, 4)]
    cm = EV.confusion_matrix(spark.createDataFrame(pairs, "a int, p int"), "a", "p")
    got = EV.classification_metrics(cm).first()
    labels = [1, 2, 3, 4]
    tp = {k: sum(a == p == k for a, p in pairs) for k in labels}
    support = {k: sum(a == k for a, _ in pairs) for k in labels}
    made = {k: sum(p == k for _, p in pairs) for k in labels}
    recall = {k: tp[k] / support[k] if support[k] else 0.0 for k in labels}
    assert np.isclose(got.Accuracy, 12 / 18) and np.isclose(got.Balanced_Accuracy, np.mean([recall[k] for k in labels if support[k]]))
    assert np.isclose(got.Macro_Recall, np.mean(list(recall.values()))) and np.isclose(got.Macro_Precision, np.mean([tp[k] / made[k] if made[k] else 0.0 for k in labels]))
    assert np.isclose(got.Macro_F1, np.mean([2 * tp[k] / (made[k] + support[k]) if made[k] + support[k] else 0.0 for k in labels]))
    assert np.isclose(got.MAE, np.mean([abs(a - p) for a, p in pairs]))


@pytest.mark.parametrize("n", [1, 37, 400, 999, 1000])
def test_sample_is_the_first_n_in_hash_order(spark, n):
    import hashlib
    keys = [f"k{i}" for i in range(1000)]
    want = sorted(keys, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))[:n]
    df = spark.createDataFrame([(k,) for k in keys], "row_key string").repartition(4)
    assert sorted(r.row_key for r in SA.sample_n(df, n).collect()) == sorted(want)
