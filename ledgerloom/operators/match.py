"""Match column titles to registry entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.similarity import name_similarity
from ledgerloom.functions.text import norm_name
from ledgerloom.operators.headers import SHEET

THRESHOLD = 0.62
ALIAS_SCORE = 0.99
ALTERNATIVES = 3


def type_bonus(expect: Column, type_: Column, leading_zero: Column, big_int: Column, role: Column) -> Column:
    """Multiplier for the agreement between what an entity expects and what a column holds."""
    strong = F.coalesce(leading_zero, F.lit(False)) | F.coalesce(big_int, F.lit(False)) | F.coalesce(role == "id", F.lit(False))
    return (
        F.when(expect == "number", F.when(type_.isin("number", "currency"), 1.0).otherwise(0.7))
        .when(expect == "date", F.when(type_.isin("date", "time"), 1.0).otherwise(0.72))
        .when(expect == "id", F.when(strong, 1.0).otherwise(0.8))
        .when(expect == "text", F.when(type_ == "boolean", 0.4).when(type_ == "string", 1.0).otherwise(0.8))
        .otherwise(0.95)
    )


def _normal(text: str) -> str:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return " ".join(words)


def title_scores(titles: DataFrame, registry: list[dict]) -> DataFrame:
    """Score of every distinct normalised ``title`` against every entity.

    The registry is a specification, not data: it is written into the plan as a literal array, so a
    title meets its aliases by an explode and no join is needed.
    """
    forms = [
        (i, e["name"], e.get("expect"), n)
        for i, e in enumerate(registry)
        for n in dict.fromkeys([_normal(e["name"]), *[_normal(a) for a in e.get("aliases", [])]])
    ]
    literal = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(name).alias("entity"), F.lit(expect).cast("string").alias("expect"), F.lit(n).alias("form"))
            for i, name, expect, n in forms
        ]
    )
    # Few titles, much work for each: spread them over all cores instead of leaving one small partition.
    spread = titles.select("title").distinct().repartition(titles.sparkSession.sparkContext.defaultParallelism, "title")
    pairs = spread.select("title", F.explode(literal).alias("a")).select("title", "a.*")
    same = F.col("title") == F.col("form")
    similarity = F.when(~same, name_similarity(F.col("title"), F.col("form")))
    return (
        pairs.withColumn("same", same)
        .withColumn("similarity", similarity)
        .groupBy("title", "ord", "entity", "expect")
        .agg(F.bool_or("same").alias("alias"), F.max("similarity").alias("best"))
        .select("title", "ord", "entity", "expect", "alias", F.when(F.col("alias"), ALIAS_SCORE).otherwise(F.col("best")).alias("base"))
    )


SHAPE = ["title", "type", "leading_zero", "big_int", "role"]


def match_columns(profile: DataFrame, registry: list[dict]) -> DataFrame:
    """Best entity per column with confidence, how it was found, and the next best ones.

    Columns with the same title and shape match alike, so each distinct shape is scored once.
    """
    known = profile.withColumn("title", norm_name(F.col("source"))).withColumn("shape", F.to_json(F.struct(*SHAPE)))
    shapes = known.select("shape", *SHAPE).distinct()
    scores = title_scores(shapes, registry)
    bonus = type_bonus(F.col("expect"), F.col("type"), F.col("leading_zero"), F.col("big_int"), F.col("role"))
    best_first = Window.partitionBy("shape").orderBy(F.desc("score"), F.desc("alias"), "ord")  # one row per entity
    ranked = (
        shapes.join(scores, "title")
        .withColumn("score", F.round(F.col("base") * bonus, 4))
        .withColumn("r", F.row_number().over(best_first))
        .filter(F.col("r") <= ALTERNATIVES + 1)
    )
    candidate = F.struct("r", "entity", F.col("score").alias("confidence"), "alias")
    top = ranked.groupBy("shape").agg(F.array_sort(F.collect_list(candidate)).alias("c"))
    first = F.get("c", F.lit(0))
    sure = first["confidence"] >= THRESHOLD
    others = F.when(sure, F.slice("c", 2, ALTERNATIVES)).otherwise(F.slice("c", 1, ALTERNATIVES))
    matched = top.select(
        "shape",
        F.when(sure, first["entity"]).alias("entity"),
        first["confidence"].alias("confidence"),
        F.when(~sure, "none").when(first["alias"], "alias").otherwise("fuzzy").alias("via"),
        (~sure).alias("suggest_new"),
        F.transform(others, lambda x: F.struct(x["entity"].alias("entity"), x["confidence"].alias("confidence"))).alias("alternatives"),
    )
    keep = [c for c in ("canonical", "type", "role") if c in profile.columns]
    return known.join(matched, "shape", "left").select(
        *SHEET, "col_index", "source", *keep, "entity", "confidence", "via", "suggest_new", "alternatives"
    )


def entity_sources(matches: DataFrame) -> DataFrame:
    """First column of each sheet that stands for an entity."""
    return matches.filter(F.col("entity").isNotNull()).groupBy(*SHEET, "entity").agg(
        F.min_by("source", "col_index").alias("source"), F.min("col_index").alias("col_index")
    )


def entity_sets(matches: DataFrame) -> DataFrame:
    """Sorted distinct entities of each sheet; empty when nothing matched. Bounded by the registry."""
    return matches.groupBy(*SHEET).agg(F.array_sort(F.collect_set("entity")).alias("entities"))
