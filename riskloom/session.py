"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours wants, whatever the cluster size.
_SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "riskloom") -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session is created by the launcher; we only add SQL
    defaults that are unset there.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # Generated scoring code for many scenarios can exceed the JIT's 8 KB
    # method cut-off; let the JIT compile it instead of interpreting it.
    jit = "-XX:-DontCompileHugeMethods"
    builder = (builder.config("spark.driver.extraJavaOptions", jit)
               .config("spark.executor.extraJavaOptions", jit)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("RISKLOOM_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.

    A folder of our own is made only on a single machine (master ``local`` or
    ``local[..]``, as in tests); on a cluster a driver's folder would be another
    disk for every executor, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="riskloom-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_dir(spark: SparkSession, name: str = "tables") -> str:
    """A fresh folder under the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/riskloom-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder now, and read back.

    For tables that are joined: a checkpoint keeps the size estimated for the plan
    behind it, so its few rows would never be broadcast and every join would
    shuffle the large side by a key of few values. A table has the size of its files.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Shuffle files go with the query that wrote them, and not when the driver's collector comes upon them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, give_back: bool = False) -> DataFrame:
    """``stored``, for large steps that several jobs read; ``release`` gives back the table.

    With ``give_back`` (a setting of the whole session, so for no task of ``at_once``) the shuffles behind it go when it is written.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "kept")
    before = spark.conf.get(CLEANUP, None)
    if give_back:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if give_back:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def release(frames: Iterable[DataFrame]) -> None:
    """Give back cached and ``kept`` frames that nothing reads any more; an empty table overwrites a kept one."""
    for f in frames:
        if path := getattr(f, "kept_at", None):
            f.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(path)
        else:
            f.unpersist()


#: Tasks of ``at_once`` that run at a time.
AT_ONCE = 4


def at_once(spark: SparkSession, tasks: Iterable[Callable]) -> list:
    """What the tasks return, in their order; several run at a time, since most of a small job's time is the driver's. All end before an error is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]
    return [f.result() for f in futures]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder now; its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
