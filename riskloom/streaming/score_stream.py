"""Incremental scoring of arriving record files with a fitted model.

The analysis itself is batch; this is the same ``batch_score`` /
``score_with_interval`` projection applied to a file stream, so newly landed
records are scored once, with exactly-once file tracking in the checkpoint.
No state is kept: scoring is a per-row projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.fit import LogitModel
from riskloom.operators.score import score_with_interval


def scored_stream(spark: SparkSession, source_dir: str, schema: T.StructType, model: LogitModel,
                  keep: list[str], max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame: ``keep`` columns plus probability and interval per new row."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source_dir)
    return score_with_interval(rows, model).select(*keep, "Predicted_Probability", "CI_Lower_95", "CI_Upper_95")


def start_scoring(spark: SparkSession, source_dir: str, schema: T.StructType, model: LogitModel,
                  keep: list[str], sink_dir: str, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Write scored rows as Parquet; the checkpoint makes restarts resume where they stopped."""
    q = (scored_stream(spark, source_dir, schema, model, keep).writeStream
         .format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()
