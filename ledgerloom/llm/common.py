"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Plain ASCII takes the faster function, which there does the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def remainder(c: Column, n: int) -> Column:
    """crc32 of the value's text modulo ``n``; null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with two keys, never null, that tell rows apart by id and text. Repeated rows share them."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", F.lit(1)).alias("key2"))


def slices(batches, rows: int = 512):
    """(column, values) of the ids and texts of Arrow batches, a bounded number of rows at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            part = b.slice(start, rows)
            yield part.column(0), part.column(1).to_pylist()
