"""Incremental ingest: new files stream in and go through the batch functions, upload by upload.

The rows of each micro-batch are kept next to the staging tables, and an upload is staged from all its rows so far. Both
steps replace what they wrote before, so an upload may arrive over several triggers, and a replay changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.siblings import plain_snake
from ledgerloom.sources.staging import Staging


def stage_stream(
    stream: DataFrame, staging: Staging, table: str, types: dict[str, str], checkpoint: str, upload_column: str = "upload_id",
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Stage every upload that arrives on ``stream`` (rows with ``pos`` and an upload column).

    Rows without an upload are staged under ``unnamed``.
    """
    arrived = f"{staging.root}/arrived/{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}/{staging.prefix}{plain_snake(table)}"

    def each(batch: DataFrame, number: int) -> None:
        named = batch.withColumn("_upload", F.coalesce(F.col(upload_column), F.lit("unnamed")))
        named.write.mode("overwrite").parquet(f"{arrived}/batch-{number}")
        spark = batch.sparkSession
        for r in spark.read.parquet(f"{arrived}/batch-{number}").select("_upload").distinct().collect():  # uploads of one trigger
            rows = spark.read.schema(named.schema).parquet(*[f"{arrived}/{c}" for c in staging._children(arrived)]).filter(F.col("_upload") == r[0])
            staging.write(table, prepare(rows.drop("_upload")), types, r[0])

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upload_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files that keep arriving under ``path``."""
    return spark.readStream.schema(schema).parquet(path)
