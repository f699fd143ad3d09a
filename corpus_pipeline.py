"""A training corpus from documents: five stages, each an operator of ``ledgerloom.llm``.

Every stage takes what the one before kept; all but the last return the columns of ``documents`` as they are. Stages drop
rows only: toxic texts; of equal texts all but the one with the largest id; of linked texts all but the one with the
smallest id; texts that hold a window of a benchmark item. A null text counts as empty and is clean. Of rows that repeat
an id and text one is left by exact dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from ledgerloom.llm.common import table
from ledgerloom.session import durable

#: Names for the keys while rows are picked, unlike any column of the documents.
KEYS = ["_row_key_1", "_row_key_2"]


def picked(docs: DataFrame, keys: list, kept: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` by their two ``keys``, joined to the two columns of ``kept`` (left_semi or left_anti).

    A merge join at every size; with left_semi, rows that share both keys are one row, of which one is left.
    """
    rows = docs.select("*", *(k.alias(n) for k, n in zip(keys, KEYS)))
    out = rows.join(kept.toDF(*KEYS).hint("merge"), KEYS, how)
    return (out.dropDuplicates(KEYS) if how == "left_semi" else out).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.with_scores(docs, table(spark, sf_dir, "labels"), docs.columns, "_score")
    return scored.filter(F.col("_score") < toxicity.THRESHOLD).drop("_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup.exact_groups(docs).filter("kept").select(F.coalesce("doc_id", F.lit(-1)), "row_key")
    norm = F.xxhash64(exact_dedup.normalised(F.col("text")))
    return picked(docs, [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), norm], kept, "left_semi")


def row_keys() -> list:
    return [F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1))]


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = ngram_join.joined(docs).filter("stays").select("key", F.lit(0)).distinct()
    return picked(docs, [row_keys()[0], F.lit(0)], kept, "left_semi")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    return picked(docs, row_keys(), found.filter("n_hit > 0").select("key", "key2").distinct(), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", benchmark), ("best-fit packing", pack)]

#: Toxicity and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep. Each stage's rows are written, and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
