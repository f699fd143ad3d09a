"""Arriving uploads are staged as in a batch, and a replay changes nothing."""

from pyspark.sql import functions as F

from ledgerloom.session import scratch_path
from ledgerloom.sources.staging import Staging
from ledgerloom.streaming.incremental import stage_stream, upload_stream


def test_stream_stages_uploads(spark):
    landing = scratch_path(spark, "landing")
    schema = "pos bigint, upload_id string, amount string"
    staging = Staging(spark, scratch_path(spark, "stream-staging"))

    def arrive(upload, n):
        rows = spark.range(n).select(F.col("id").alias("pos"), F.lit(upload).cast("string").alias("upload_id"), F.col("id").cast("string").alias("amount"))
        rows.coalesce(1).write.mode("append").parquet(landing)

    def run(checkpoint):
        stage_stream(upload_stream(spark, landing, schema), staging, "Sales", {"amount": "decimal"}, checkpoint).awaitTermination()
        return {r["upload_id"]: (r["n"], r["s"]) for r in staging.read("Sales").groupBy("upload_id").agg(F.count("*").alias("n"), F.sum("amount").alias("s")).collect()}

    first = scratch_path(spark, "stream-state")
    arrive("u1", 4)
    assert run(first) == {"u1": (4, 6.0)}
    arrive("u2", 3)
    want = {"u1": (4, 6.0), "u2": (3, 3.0)}
    assert run(first) == want
    arrive("u1", 2)  # the rest of an upload, a trigger later
    arrive(None, 1)
    want = {"u1": (6, 7.0), "u2": (3, 3.0), "unnamed": (1, 0.0)}
    assert run(first) == want
    assert run(scratch_path(spark, "stream-state")) == want
