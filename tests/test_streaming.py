"""File-stream scoring gives the same rows as batch scoring."""

import tempfile

from pyspark.sql import functions as F

from riskloom.operators.score import score_with_interval
from riskloom.plans.bindings import FIXED_LOGIT, prepared_records
from riskloom.streaming.score_stream import start_scoring
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="riskloom-stream-")
    src = prepared_records(spark, SF_SMALL).select("row_key", *FIXED_LOGIT.spec.features)
    src.write.parquet(f"{base}/in")
    q = start_scoring(spark, f"{base}/in", src.schema, FIXED_LOGIT, ["row_key"], f"{base}/out", f"{base}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{base}/out")
    want = score_with_interval(src, FIXED_LOGIT).select("row_key", "Predicted_Probability")
    diff = got.join(want, "row_key").filter(
        F.abs(got["Predicted_Probability"] - want["Predicted_Probability"]) > 1e-12).count()
    assert got.count() == src.count() and diff == 0
