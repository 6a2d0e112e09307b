"""Stored sets, CSV rejects, label tables of any size, Poisson replicates."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import labels as LB
from riskloom.operators import sampling as SA
from riskloom.sources.tables import ingest_csv, input_fingerprint, load_or_compute, write_table


def _two(spark, calls, second=None):
    def compute():
        calls.append(1)
        codes = spark.createDataFrame([("01",), ("2",)], "code string")
        return {"codes": codes, "sums": second or codes.agg(F.count("*").alias("n"))}
    return compute


def test_a_set_is_published_as_a_whole(spark, tmp_path):
    """A run that dies between two tables leaves no set; another input, or other tables, is another set."""
    base, calls = str(tmp_path / "sets"), []
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        load_or_compute(spark, base, ["codes", "sums"], _two(spark, calls, broken), "a")
    got = load_or_compute(spark, base, ["codes", "sums"], _two(spark, calls), "a")
    assert sorted(r.code for r in got["codes"].collect()) == ["01", "2"] and got["sums"].first().n == 2
    load_or_compute(spark, base, ["codes", "sums"], _two(spark, calls), "a")
    assert len(calls) == 2
    load_or_compute(spark, base, ["codes", "sums"], _two(spark, calls), "b")
    load_or_compute(spark, base, ["codes"], _two(spark, calls), "b")
    assert len(calls) == 4
    # the first input is still there
    assert load_or_compute(spark, base, ["codes", "sums"], _two(spark, calls), "a")["codes"].schema == T.StructType([T.StructField("code", T.StringType())]) and len(calls) == 4


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    one = input_fingerprint(spark, path)
    assert one == input_fingerprint(spark, path)
    spark.range(1).write.mode("append").parquet(path)
    assert one != input_fingerprint(spark, path)


def test_csv_rejects_and_pruned_layout(spark, tmp_path):
    base = str(tmp_path)
    lines = ["k,v,code", "1,2.5,01", "x,1.0,02", "3,none,03", "4,,04", '5,1e3,"a,b"', "6,7.5,05,more"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{base}/csv")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("code", T.StringType())])
    got = ingest_csv(spark, f"{base}/csv", schema, f"{base}/out", f"{base}/rejects", {"half": (F.col("k") % 2).cast("int")})
    assert sorted((r.k, r.v, r.code) for r in got.collect()) == [(1, 2.5, "01"), (4, None, "04"), (5, 1000.0, "a,b")]
    assert sorted(r._corrupt_record for r in spark.read.parquet(f"{base}/rejects").collect()) == ["3,none,03", "6,7.5,05,more", "x,1.0,02"]
    plan = got.where("half = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(half" in plan and got.where("half = 1").count() == 2
    with pytest.raises(Exception):
        ingest_csv(spark, f"{base}/csv", schema, f"{base}/strict").collect()


def test_write_table_formats(spark, tmp_path):
    df = spark.createDataFrame([("01", 1)], "code string, n int")
    assert spark.read.parquet(write_table(df, str(tmp_path / "p"))).collect() == df.collect()


def test_labels_from_a_large_table(spark):
    """100,000 labels; the longest variable wins, levels meet by key, what has no label is shown as it is."""
    codes = spark.range(100_000).select(F.lit("P_TYPE").alias("label_variable"), F.col("id").cast("string").alias("label_code"), F.concat(F.lit("type "), F.col("id")).alias("label"))
    more = spark.createDataFrame([("P", "TYPE_7", "wrong"), ("P_TYPE", "ab", "letters"), ("P_TYPE", "12", "twelve")], codes.schema)
    labels = LB.keyed_labels(codes.unionByName(more))
    variables = spark.createDataFrame([("P", "Part"), ("P_TYPE", "Part type"), ("S", "Size")], "variable string, variable_label string")
    overrides = spark.createDataFrame([("const", "Intercept")], "term string, override string")
    terms = spark.createDataFrame([(t,) for t in ("P_TYPE_7", "P_TYPE_099999", "P_TYPE_AB", "P_TYPE_zz", "P_x", "S_1_2", "const", "no_such", "plain", "", "P_TYPE_12")], "term string")
    got = {r.term: r.label for r in LB.term_labels(terms, variables, labels, overrides).collect()}
    assert got == {"P_TYPE_7": "type 7", "P_TYPE_099999": "type 99999", "P_TYPE_AB": "letters", "P_TYPE_zz": "Part type (zz)", "P_x": "Part (x)", "S_1_2": "Size (1_2)",
                   "const": "Intercept", "no_such": "no such", "plain": "plain", "": "", "P_TYPE_12": "twelve"}
    df = spark.createDataFrame([(1, " 07 "), (2, "7.0"), (3, None), (4, ""), (5, "x")], "i int, c string")
    out = LB.decode_labels(df, {"shown": ("P_TYPE", F.col("c"))}, labels)
    assert sorted((r.i, r.shown) for r in out.collect()) == [(1, "type 7"), (2, "type 7"), (3, None), (4, None), (5, None)]


def test_poisson_replicates(spark):
    """About as many draws as rows in each replicate, means around the sample's, and the same for any partitioning."""
    df = spark.range(5000).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 100).cast("double").alias("v"))
    one = {r.replicate: r for r in SA.bootstrap_replicates(df, F.col("v"), 10).collect()}
    assert set(one) == set(range(10))
    assert all(abs(r.n_draws - 5000) < 350 and abs(r["mean"] - 49.5) < 2.5 and r["min"] == 0 and r["max"] == 99 and abs(r["std"] - 28.87) < 1.5 for r in one.values())
    assert len({r.n_draws for r in one.values()}) > 5
    again = {r.replicate: r for r in SA.bootstrap_replicates(df.repartition(7), F.col("v"), 10).collect()}
    assert all(one[k].n_draws == again[k].n_draws and math.isclose(one[k]["mean"], again[k]["mean"], rel_tol=1e-12) for k in one)
    assert SA.bootstrap_replicates(df.limit(0), F.col("v"), 3).collect() == []
