"""Classifier evaluation from any scored table, as aggregations.

All metrics are computed from small aggregates (a confusion table, per-score
class counts), so a whole scored population costs one or two passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.presets import COMPARISON_COLUMNS, COMPARISON_RENAMES, METRIC_COLUMNS


def threshold_grid(start: float = 0.01, stop: float = 0.50, num: int = 50) -> list[float]:
    return [float(t) for t in np.linspace(start, stop, num)]


def predict_at(p: str | Column, threshold: float) -> Column:
    pc = F.col(p) if isinstance(p, str) else p
    return (pc >= F.lit(float(threshold))).cast("int")


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Long confusion table (actual, predicted, n) over all pairs of labels that occur on either side.

    Pairs that do not occur have n = 0. Rows without an actual or a predicted
    label are left out.
    """
    seen = (df.select(F.col(actual).cast("bigint").alias("actual"), F.col(predicted).cast("bigint").alias("predicted"))
            .dropna().groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n")))
    return _all_cells(seen)


def _all_cells(seen: DataFrame) -> DataFrame:
    """Observed cells (actual, predicted, n) filled up with zeros; classes are few, so this is one row's work."""
    rows = seen.agg(*_row_aggregates()).select("_n", "_labels", F.explode("_labels").alias("actual"))
    pairs = rows.select("_n", "actual", F.explode("_labels").alias("predicted"))
    return pairs.select("actual", "predicted", _cell(F.col("actual"), F.col("predicted")).alias("n"))


def matrix_text(cm: DataFrame) -> DataFrame:
    """The confusion table as one row, ``Confusion_Matrix``: '[[n, n], [n, n]]', rows by actual label."""
    return cm.agg(*_row_aggregates()).select(_text_column().alias("Confusion_Matrix"))


def _per_label(cm: DataFrame) -> DataFrame:
    """Per label of the union of actual and predicted: tp, support, predicted count."""
    a = cm.select(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("pred"),
                  F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"),
                  (F.col("n") * F.abs(F.col("actual") - F.col("predicted"))).alias("abs_err"))
    p = cm.select(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                  F.col("n").alias("pred"), F.lit(0).cast("bigint").alias("tp"),
                  F.lit(0).cast("bigint").alias("abs_err"))
    return (a.unionByName(p).groupBy("label")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("pred").alias("pred"),
                 F.sum("abs_err").alias("abs_err")))


def _ratio0(num: Column, den: Column) -> Column:
    """num / den with 0 for 0/0 (zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def classification_report(cm: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support."""
    pl = _per_label(cm)
    return pl.select(
        "label",
        _ratio0(F.col("tp"), F.col("pred")).alias("precision"),
        _ratio0(F.col("tp"), F.col("support")).alias("recall"),
        _ratio0(2 * F.col("tp"), 2 * F.col("tp") + (F.col("pred") - F.col("tp"))
                + (F.col("support") - F.col("tp"))).alias("f1"),
        F.col("support"))


def _row_aggregates() -> list[Column]:
    """Cells (actual, predicted, n) as one row: ``_n`` (map by pair), ``_labels`` (all labels in order). Classes are few."""
    return [F.map_from_entries(F.collect_list(F.struct(F.struct("actual", "predicted"), "n"))).alias("_n"),
            F.array_sort(F.array_union(F.collect_set("actual"), F.collect_set("predicted"))).alias("_labels")]


def _cell(a: Column, p: Column) -> Column:
    return F.coalesce(F.col("_n")[F.struct(a.alias("actual"), p.alias("predicted"))], F.lit(0).cast("bigint"))


def _total(items: Column, f) -> Column:
    """Sum of f over an array."""
    return F.aggregate(items, F.lit(0).cast("double"), lambda acc, x: acc + f(x).cast("double"))


def _metric_columns() -> list[Column]:
    """The metrics of ``classification_metrics`` from the columns of ``_row_aggregates``."""
    labels = F.col("_labels")
    k = F.size(labels).cast("double")
    support = lambda x: _total(labels, lambda p: _cell(x, p))
    made = lambda x: _total(labels, lambda a: _cell(a, x))
    recall = lambda x: _ratio0(_cell(x, x), support(x))
    precision = lambda x: _ratio0(_cell(x, x), made(x))
    f1 = lambda x: _ratio0(2 * _cell(x, x), made(x) + support(x))
    n = _total(labels, support)
    present = _total(labels, lambda x: (support(x) > 0).cast("int"))
    return [F.try_divide(_total(labels, lambda x: _cell(x, x)), n).alias("Accuracy"), F.try_divide(_total(labels, lambda x: F.when(support(x) > 0, recall(x)).otherwise(0.0)), present).alias("Balanced_Accuracy"),
            F.try_divide(_total(labels, precision), k).alias("Macro_Precision"), F.try_divide(_total(labels, recall), k).alias("Macro_Recall"),
            F.try_divide(_total(labels, f1), k).alias("Macro_F1"), F.try_divide(_total(labels, lambda a: _total(labels, lambda p: _cell(a, p) * F.abs(a - p))), n).alias("MAE")]


def _text_column() -> Column:
    """'[[n, n], [n, n]]', rows by actual label, from the columns of ``_row_aggregates``."""
    row = lambda a: F.concat(F.lit("["), F.array_join(F.transform("_labels", lambda p: _cell(a, p).cast("string")), ", "), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform("_labels", row), ", "), F.lit("]"))


def classification_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall over classes present), macro P/R/F1
    over the label union, and MAE on the labels, as one row.

    The cells become one row first, and all metrics are expressions on it.
    """
    return cm.agg(*_row_aggregates()).select(*_metric_columns())


def roc_auc(df: DataFrame, label_col: str, score_col: str, positive=1) -> DataFrame:
    """Exact ROC AUC (Mann-Whitney, ties count half) as one row; NULL with one class."""
    pos = (F.col(label_col) == F.lit(positive)).cast("bigint")
    by_score = (df.filter(F.col(score_col).isNotNull())
                .groupBy(F.col(score_col).cast("double").alias("score"))
                .agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")))
    return auc_from_counts(by_score)


_STATE = "g long, part int, pos double, neg double, pairs double"


def auc_states(by_score: DataFrame) -> DataFrame:
    """(g, part, pos, neg, pairs): the AUC state of each range part of (g, score, pos, neg) counts.

    ``pairs`` counts a positive above a negative inside the part, ties half. Two
    neighbouring states merge to (pos + pos', neg + neg', pairs + pairs' + pos' * neg),
    so one shuffle by range is enough and nothing runs over all rows.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, list[float]] = {}
        for batch in batches:
            g, pos, neg = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "pos", "neg"))
            for k in np.unique(g):
                own = g == k
                p, n = pos[own].astype(float), neg[own].astype(float)
                state = states.setdefault(int(k), [0.0, 0.0, 0.0])
                before = state[1] + np.cumsum(n) - n
                state[2] += float((p * (before + 0.5 * n)).sum())
                state[0] += float(p.sum())
                state[1] += float(n.sum())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.int64()), pa.array([part] * len(states), pa.int32()),
                                          *[pa.array([v[i] for v in states.values()], pa.float64()) for i in range(3)]], names=["g", "part", "pos", "neg", "pairs"])

    ranged = by_score.select("g", "score", "pos", "neg").repartitionByRange("g", "score").sortWithinPartitions("g", "score")
    return ranged.mapInArrow(fold, _STATE)


def merged_auc(states: DataFrame) -> DataFrame:
    """(g, auc) of states, merged in the order of their parts (one row a part and group); NULL with one class."""
    start = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(0.0).alias("pairs"))
    every = F.array_sort(F.collect_list(F.struct("part", "pos", "neg", "pairs")))
    one = F.aggregate(every, start, lambda a, x: F.struct((a["pos"] + x["pos"]).alias("pos"), (a["neg"] + x["neg"]).alias("neg"),
                                                          (a["pairs"] + x["pairs"] + x["pos"] * a["neg"]).alias("pairs")))
    return states.groupBy("g").agg(one.alias("s")).select("g", F.try_divide("s.pairs", F.col("s.pos") * F.col("s.neg")).alias("auc"))


def auc_from_counts(by_score: DataFrame) -> DataFrame:
    """ROC_AUC from (score, pos, neg) counts, one row also without any."""
    found = merged_auc(auc_states(by_score.withColumn("g", F.lit(0).cast("bigint"))))
    return found.agg(F.max("auc").alias("ROC_AUC"))


def roc_auc_ovr_macro(df: DataFrame, label_col: str, prob_cols: dict) -> DataFrame:
    """Mean one-vs-rest AUC over classes; NULL if any class AUC is undefined."""
    pairs = F.array(*[F.struct(F.lit(k).cast("bigint").alias("g"), F.col(c).cast("double").alias("score"))
                      for k, c in prob_cols.items()])
    long = df.select(F.col(label_col).cast("bigint").alias("_y"), F.inline(pairs)).filter(F.col("score").isNotNull())
    pos = (F.col("_y") == F.col("g")).cast("bigint")
    by_score = long.groupBy("g", "score").agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    return merged_auc(auc_states(by_score)).agg(F.when(F.count_if(F.col("auc").isNull()) == 0, F.avg("auc")).alias("ROC_AUC"))


def threshold_sweep(df: DataFrame, label_col: str, score_col: str,
                    thresholds: list[float] | None = None) -> DataFrame:
    """Best threshold by balanced accuracy in ONE data pass; the first of ``thresholds`` wins ties.

    Each row is counted at the number of thresholds that its score reaches, so
    the data pass makes one small table; running sums over it give the true and
    false positives of all thresholds.
    """
    ts = thresholds or threshold_grid()
    ascending = sorted(range(len(ts)), key=lambda k: ts[k])
    s, y = F.col(score_col).cast("double"), F.col(label_col).cast("int")
    grid = F.array(*[F.lit(float(ts[k])) for k in ascending])
    reached = F.coalesce(F.size(F.filter(grid, lambda t: s >= t)), F.lit(0))
    counted = df.select(reached.alias("r"), y.alias("y")).groupBy("r").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    one = counted.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.collect_list(F.struct("r", "pos", "neg")).alias("all"))

    def above(k: int, side: str) -> Column:
        return F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["r"] > k, x[side]).otherwise(0))

    rows = []
    for k, i in enumerate(ascending):
        tpr = F.try_divide(above(k, "pos"), F.col("P"))
        tnr = F.try_divide(F.col("N") - above(k, "neg"), F.col("N"))
        both = F.when(tpr.isNull(), tnr).when(tnr.isNull(), tpr).otherwise((tpr + tnr) / 2)
        rows.append(F.struct(F.lit(i).alias("k"), F.lit(float(ts[i])).alias("t"), both.alias("bacc")))
    best = one.select(F.inline(F.array(*rows))).agg(F.max_by(F.struct("t", "bacc"), F.struct(F.col("bacc"), -F.col("k"))).alias("b"))
    return best.select(F.col("b.t").alias("best_threshold"), F.col("b.bacc").alias("best_balanced_accuracy"))


def evaluate_at(df: DataFrame, label_col: str, prob_col: str, cases: list[tuple[str, float]]) -> DataFrame:
    """One metrics row (Model .. MAE, Confusion_Matrix) for each (title, threshold) of a scored table.

    Rows are counted by (label, score) once; the matrices and metrics of all
    thresholds and the AUC come from that one exchange. A labelled row without a
    score is an error.
    """
    p = F.coalesce(F.col(prob_col).cast("double"), F.raise_error(F.lit(f"a row to evaluate has no {prob_col}")).cast("double"))
    counted = df.filter(F.col(label_col).isNotNull()).select(F.col(label_col).cast("int").alias("_y"), p.alias("_p")) \
        .groupBy("_y", "_p").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("_case"), F.lit(float(t)).alias("_t")) for k, (_, t) in enumerate(cases)])
    cells = counted.select("_y", "_p", "_n", F.inline(wanted)) \
        .groupBy("_case", F.col("_y").cast("bigint").alias("actual"), (F.col("_p") >= F.col("_t")).cast("bigint").alias("predicted")).agg(F.sum("_n").alias("n"))
    rows = cells.groupBy("_case").agg(*_row_aggregates())
    auc = auc_from_counts(counted.groupBy(F.col("_p").alias("score")).agg(F.sum(F.when(F.col("_y") == 1, F.col("_n")).otherwise(0)).alias("pos"),
                                                                       F.sum(F.when(F.col("_y") == 1, 0).otherwise(F.col("_n"))).alias("neg")))
    title, threshold = (F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_case") + 1) for values in ([t for t, _ in cases], [float(t) for _, t in cases]))
    accuracy, balanced, precision, recall, f1, mae = _metric_columns()
    return rows.select(title.alias("Model"), threshold.alias("Threshold"), accuracy, balanced, precision, recall, f1,
                       auc.select("ROC_AUC").scalar().alias("ROC_AUC"), mae, _text_column().alias("Confusion_Matrix"))


def metrics_row(cells: DataFrame, title: str, auc: Column) -> DataFrame:
    """One metrics row of cells (actual, predicted, n) and an AUC that is known already."""
    accuracy, balanced, precision, recall, f1, mae = _metric_columns()
    return cells.agg(*_row_aggregates()).select(F.lit(title).alias("Model"), accuracy, balanced, precision, recall, f1, auc.alias("ROC_AUC"), mae,
                                                _text_column().alias("Confusion_Matrix"))


def evaluate_binary(df: DataFrame, label_col: str, prob_col: str, threshold: float = 0.5,
                    title: str = "Model") -> DataFrame:
    """One metrics row for a scored table at a threshold."""
    return evaluate_at(df, label_col, prob_col, [(title, threshold)])


def standardize_metrics(df: DataFrame, family: str) -> DataFrame:
    """Rename metric columns to the comparison names, pad absent ones with NULL, add Family."""
    present = {COMPARISON_RENAMES.get(c, c): c for c in df.columns}
    out = []
    for c in COMPARISON_COLUMNS:
        if c == "Family":
            out.append(F.lit(family).alias("Family"))
        elif c in present:
            src = F.col(present[c])
            out.append((src if c == "Model" else src.cast("double")).alias(c))
        else:
            out.append(F.lit(None).cast("string" if c == "Model" else "double").alias(c))
    return df.select(out)


def sort_results(df: DataFrame) -> DataFrame:
    """By ROC_AUC descending (missing last); by Accuracy if no ROC_AUC exists at all."""
    has_auc = df.agg(F.max(F.col("ROC_AUC").isNotNull())).scalar()
    key = F.when(F.coalesce(has_auc, F.lit(False)), F.col("ROC_AUC")).otherwise(F.col("Accuracy"))
    return df.orderBy(key.desc_nulls_last(), F.col("Model"))


def comparison_table(results: DataFrame, sort_by: str = "ROC_AUC") -> DataFrame:
    """Keep the known metric columns that exist, sorted descending by ``sort_by``."""
    keep = [c for c in METRIC_COLUMNS if c in results.columns]
    out = results.select(keep)
    return out.orderBy(F.col(sort_by).desc_nulls_last(), F.col("Model")) if sort_by in keep else out
