"""Session helpers: durable intermediate tables and the folder that holds them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: Tables written in between and staged are large beside what it costs to pack them well.
COMPRESSION = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-mode session (tests, laptops) may fall back to a temporary folder of the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back. ``by``: columns of few values, each of which gets a folder of its own.

    Cuts the lineage so that a lost executor re-reads files instead of recomputing, and gives the
    optimizer the true size, so it broadcasts the table only when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path, compression=COMPRESSION)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, metrics: dict[str, Column], write: Callable[[DataFrame], None]) -> dict:
    """Run ``write(df)`` and return the aggregates that the same job saw on its way; 0 where it had nothing to see."""
    seen = Observation()
    write(df.observe(seen, *[m.alias(n) for n, m in metrics.items()]))
    found = seen.get
    return {n: found.get(n) or 0 for n in metrics}
