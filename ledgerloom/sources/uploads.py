"""Uploaded files: a manifest by content hash, and removal of an upload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def upload_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``file_id, file_name, ext, size, uploaded_at``, newest first; equal bytes have equal ids.

    Hashing needs a file's bytes in one task, as with any content hash; files are hashed in parallel.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.select(
            F.substring(F.sha1("content"), 1, 12).alias("file_id"), name.alias("file_name"),
            F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"), F.col("length").alias("size"),
            F.col("modificationTime").alias("uploaded_at"),
        )
        .filter(F.col("file_name") != "")
        .orderBy(F.desc("uploaded_at"), "file_id")
    )


def delete_upload(manifest: DataFrame, file_id: str) -> DataFrame:
    """Manifest without one upload."""
    return manifest.filter(F.col("file_id") != file_id)
