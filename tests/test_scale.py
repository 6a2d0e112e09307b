"""Plans that hold at size: small tables are broadcast by their true size, rows are not expanded, joins run once."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import labels as LB
from riskloom.operators import hygiene as HY
from riskloom.operators import sampling as SA
from riskloom.operators import whatif as WI
from riskloom.plans import catalog
from riskloom.plans.bindings import FIXED_LOGIT

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def rows_of(spark, n=4000):
    """Rows whose plan the planner takes for far larger than they are, as it does behind joins."""
    a = spark.range(n).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"), F.concat(F.lit("k"), F.col("id")).alias("row_key"))
    b = spark.range(n).select(F.col("id").alias("b"))
    return a.join(b.repartition(4), a.id == b.b).drop("b")


def test_rare_levels_are_broadcast(spark):
    df = rows_of(spark)
    rule = HY.fit_rare_levels(df, ["g"], min_count=1334)
    out = rule.apply(df.select("id", "g"))
    assert plan(out.select("g")).split("== Physical Plan ==")[1].count("SortMergeJoin") == 0
    assert {r.g: r["count"] for r in out.groupBy("g").count().collect()} == {"0": 1334, "RARE": 2666}


def test_cut_offs_are_broadcast(spark):
    out = SA.stratified_split(rows_of(spark), "g", 0.3)
    assert plan(out).split("== Physical Plan ==")[1].count("SortMergeJoin") == 0
    assert {r.g: r.n for r in out.groupBy("g").agg(F.sum("is_test").alias("n")).collect()} == {"0": math.ceil(1334 * 0.3), "1": 400, "2": 400}


def test_labels_are_broadcast(spark):
    out = LB.decode_labels(rows_of(spark), {"shown": ("v", F.col("g"))}, LB.label_table(spark, {"v": {"0": "none", "01": "one"}}))
    assert plan(out).split("== Physical Plan ==")[1].count("SortMergeJoin") == 0
    assert {r.shown: r["count"] for r in out.groupBy("shown").count().collect()} == {"none": 1334, "one": 1333, None: 1333}


def test_values_without_labels_are_not_looked_up(spark):
    df = spark.createDataFrame([(1.0,), (2.25,), (None,)], "v double")
    shown = df.select(LB.format_value(F.lit("other"), F.lit(None).cast("string"), F.col("v"), {"v": {"1": "one"}}).alias("s"))
    assert "element_at" not in plan(shown).split("== Optimized Logical Plan ==")[1]
    assert [r.s for r in shown.collect()] == ["1", "2.2", "Missing"] or [r.s for r in shown.collect()] == ["1", "2.3", "Missing"]
    known = df.select(LB.format_value(F.lit("v"), F.lit(None).cast("string"), F.col("v"), {"v": {"1": "one"}}).alias("s"))
    assert known.first().s == "one"


def test_replicates_are_summed_in_the_task(spark):
    data = [(f"k{i % 40}é", float(i) if i % 7 else None) for i in range(60)] + [(None, 1.0), ("x", float("nan")), ("big", math.inf)]
    df = spark.createDataFrame(data, "row_key string, v double").repartition(5)
    out = SA.bootstrap_replicates(df, F.col("v"), 6, seed=7)
    assert "Generate" not in plan(out)
    draws = {}
    for key, v in data:
        if key is None or v is None or math.isnan(v):
            continue
        for r in range(6):
            h = hashlib.md5(f"7:poisson:{r // 4}:{key}".encode()).hexdigest()
            u = int(h[8 * (r % 4):8 * (r % 4) + 8], 16)
            draws.setdefault(r, []).extend([v] * sum(u >= t for t in SA.POISSON_LIMITS))
    got = {r.replicate: r for r in out.collect()}
    assert sorted(got) == sorted(r for r, d in draws.items() if d)
    for r, row in got.items():
        d = draws[r]
        assert (row.n_draws, row.min, row.max) == (len(d), min(d), max(d))
        if math.isfinite(max(d)):
            assert row["mean"] == pytest.approx(np.mean(d)) and row["std"] == pytest.approx(np.std(d, ddof=1))


@pytest.mark.parametrize("nan", [False, True])
def test_scenario_averages_equal_the_expressions(spark, nan):
    spec = FIXED_LOGIT.spec
    cols = [(c, "string" if c in spec.levels else "double") for c in spec.features]
    rng = np.random.default_rng(1)
    data = [tuple(str(rng.choice(spec.levels[c])) if t == "string" else float(rng.integers(1, 50)) for c, t in cols) for _ in range(50)]
    data += [tuple(None for _ in cols), tuple(None if c == "p_size" else v for (c, _), v in zip(cols, data[0]))]
    if nan:
        data.append(tuple(math.nan if c == "p_size" else v for (c, _), v in zip(cols, data[0])))
    pop = spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in cols))
    overrides = [{}, {"o_orderpriority": "2-HIGH"}, {"p_size": 3.0, "l_linestatus": "O"}]
    out = WI.scenario_averages(pop, FIXED_LOGIT, overrides)
    assert "MapInArrow" in plan(out)
    scored, aggs = WI.scenario_means(pop, FIXED_LOGIT, overrides)
    want, got = scored.agg(*aggs).first(), out.first()
    for c in got.asDict():
        assert got[c] == pytest.approx(want[c], nan_ok=True), c


@pytest.mark.parametrize("name", ["stratified_split", "duplicate_columns", "bootstrap_draws", "scenario_labels"])
def test_records_are_joined_once(spark, name, monkeypatch):
    """Queries of several passes read what is kept of the records."""
    seen = []
    keep = catalog.stored
    monkeypatch.setattr(catalog, "stored", lambda df: seen.append(df) or keep(df))
    out = catalog.QUERIES[name](spark, SF_SMALL)
    assert "lineitem" in plan(seen[0])
    assert "lineitem" not in plan(out)
