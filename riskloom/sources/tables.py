"""Typed scans, the record binding, CSV ingestion and result sinks."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.presets import RECORD_KEY_COLUMNS

# Explicit schemas: never infer (inference turns "01" into 1).
SCHEMAS: dict[str, T.StructType] = {
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampType()),
    ]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
    "part": T.StructType([
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_brand", T.StringType()),
        T.StructField("p_type", T.StringType()),
        T.StructField("p_size", T.IntegerType()),
        T.StructField("p_retailprice", T.DoubleType()),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]),
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with the declared schema (column pruning and pushdown stay on)."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def record_key(prefix: str = "") -> F.Column:
    """Unique, engine-independent text key of a record row (used by hashed draws):
    the line-item keys plus price in cents and ship date."""
    return F.concat_ws(
        "|",
        *[F.col(c).cast("string") for c in RECORD_KEY_COLUMNS],
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        F.col("l_shipdate").cast("date").cast("string"),
    ).alias(f"{prefix}row_key")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table: one row per line item with order, customer and part attributes.

    Joins are left to Catalyst/AQE: customer and part grow with the data, so no
    broadcast hint; the planner broadcasts them only when its size statistics allow.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    # orders meet customers first, so that line items are shuffled once less
    oc = o.join(c, o.o_custkey == c.c_custkey)
    joined = (li.join(oc, li.l_orderkey == oc.o_orderkey)
              .join(p, F.col("l_partkey") == p.p_partkey))
    return joined.select(
        record_key(),
        *RECORD_KEY_COLUMNS,
        "l_returnflag", "l_linestatus", "o_orderpriority", "o_orderstatus", "c_mktsegment",
        "p_type", "p_brand",
        "l_quantity", "l_discount", F.col("p_size").cast("double").alias("p_size"), "c_acctbal",
        F.year("l_shipdate").alias("ship_year"), F.year("o_orderdate").alias("order_year"),
    )


def shape_summary(df: DataFrame) -> DataFrame:
    """Row and column count of a table as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a result table (Parquet by default, CSV with header on request)."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("compression", "snappy").parquet(path)
    return path


def ingest_csv(spark: SparkSession, csv_path: str, schema: T.StructType, out_path: str, rejects_path: str | None = None,
               partition_by: dict[str, Column] | None = None) -> DataFrame:
    """CSV with header -> typed snappy Parquet; returns the Parquet-backed frame.

    Lines that do not fit the schema go, as they are, to a table at
    ``rejects_path`` (``_corrupt_record``); without one they stop the run.
    ``partition_by`` names derived columns by which the output is laid out, so
    that a filter on them prunes folders.
    """
    derived = partition_by or {}
    mode = "PERMISSIVE" if rejects_path else "FAILFAST"
    raw = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("header", True).option("mode", mode) \
        .option("columnNameOfCorruptRecord", "_corrupt_record").csv(csv_path)
    if rejects_path:
        # the reader fills this column only if it reads the others too
        write_table(raw.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record", F.struct(*schema.names).alias("parsed")), rejects_path)
        raw = raw.where(F.col("_corrupt_record").isNull())
    good = raw.select(*schema.names).withColumns(derived)
    good.write.mode("overwrite").option("compression", "snappy").partitionBy(*derived).parquet(out_path)
    return spark.read.schema(good.schema).parquet(out_path)


def input_fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files at the paths; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", F.col("modificationTime").cast("string").alias("time"))
    row = files.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "time")).alias("hash")).first()
    return f"{row['n']}-{row['size']}-{row['hash']}"


_MANIFEST = "fingerprint string, folder string, tables map<string,string>, published timestamp"


def load_or_compute(spark: SparkSession, base: str, names: list[str], compute: Callable[[], dict[str, DataFrame]], fingerprint: str = "") -> dict[str, DataFrame]:
    """The set of tables ``names`` stored under ``base`` for this input, or computed and stored now.

    All tables of a set are written to a folder of their own; only then one row
    of the manifest (fingerprint of the input, folder, schema of every table) is
    appended, which publishes them together. A set without its row (a run that
    died between two tables), of another input, or with other tables is not
    there, and is computed again. Tables are typed Parquet, so codes such as "01"
    survive the round trip.
    """
    def stored() -> dict[str, DataFrame] | None:
        try:
            rows = spark.read.schema(_MANIFEST).parquet(f"{base}/manifest")
            last = rows.where(F.col("fingerprint") == fingerprint).orderBy(F.desc("published")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if last is None or set(last["tables"]) != set(names):
            return None
        return {n: spark.read.schema(T.StructType.fromJson(json.loads(last["tables"][n]))).parquet(f"{last['folder']}/{n}") for n in names}

    if (found := stored()) is not None:
        return found
    folder = f"{base}/set-{uuid.uuid4().hex[:12]}"
    produced = compute()
    for n in names:
        write_table(produced[n], f"{folder}/{n}")
    row = (fingerprint, folder, {n: produced[n].schema.json() for n in names}, datetime.datetime.now())
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return stored()
