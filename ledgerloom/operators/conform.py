"""Give cleaned columns their canonical names, stack member sheets, and check the outcome."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.casts import coerce, storage_type
from ledgerloom.operators.headers import SHEET

OVERRIDE = 2.0
UNMATCHED = -1.0


def canonical_map(schema: DataFrame, matches: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Canonical name of every schema column: ``file, sheet, position, name, target, confidence, canonical``.

    ``overrides(file, sheet, source, entity)`` are confirmed by the user. The surest claim on a name
    wins it, the earlier column on ties; the others keep their own name, numbered if still equal.
    """
    if overrides is None:
        overrides = schema.select(*SHEET, "source", F.col("name").alias("override")).limit(0)
    else:
        overrides = overrides.select(*SHEET, "source", F.col("entity").alias("override"))
    best = matches.select(*SHEET, "source", "entity", F.col("confidence").alias("score"), "col_index")
    # Equal titles in one sheet: the last column speaks for the title.
    best = best.groupBy(*SHEET, "source").agg(F.max_by(F.struct("entity", "score"), "col_index").alias("m"))
    combined = F.col("time_source").isNotNull()
    key = F.when(combined, F.col("name")).otherwise(F.col("source"))
    claims = (
        schema.withColumn("_key", key)
        .join(overrides.withColumnRenamed("source", "_key"), [*SHEET, "_key"], "left")
        .join(best, [*SHEET, "source"], "left")
        .withColumn(
            "target",
            F.when(combined, F.coalesce("override", F.lit("order_date")))
            .when(F.col("override").isNotNull(), F.col("override"))
            .otherwise(F.coalesce("m.entity", "name")),
        )
        .withColumn(
            "confidence",
            F.when(combined | F.col("override").isNotNull(), F.lit(OVERRIDE))
            .when(F.col("m.entity").isNotNull(), F.col("m.score"))
            .otherwise(F.lit(UNMATCHED)),
        )
    )
    # Windows hold the columns of one sheet, never its rows.
    claim = Window.partitionBy(*SHEET, "target").orderBy(F.desc("confidence"), "position")
    same = Window.partitionBy(*SHEET, "given").orderBy("position")
    return (
        claims.withColumn("given", F.when(F.row_number().over(claim) == 1, F.col("target")).otherwise(F.col("name")))
        .withColumn("turn", F.row_number().over(same))
        .select(
            *SHEET, "position", "name", "type", "target", "confidence",
            F.when(F.col("turn") > 1, F.concat_ws("_", "given", F.col("turn").cast("string"))).otherwise(F.col("given")).alias("canonical"),
        )
    )


def map_dict(mapping: DataFrame, file: str, sheet: str) -> dict[str, tuple[str, str]]:
    """Own name -> (canonical name, declared type) for one sheet; a handful of rows."""
    rows = mapping.filter((F.col("file") == file) & (F.col("sheet") == sheet)).orderBy("position").collect()
    return {r["name"]: (r["canonical"], r["type"]) for r in rows}


@dataclass
class Member:
    """One conformed sheet: rows under canonical names and the declared type of each; ``carried`` columns only follow their rows."""

    name: str
    rows: DataFrame
    types: dict[str, str]
    carried: tuple[str, ...] = ()


def conform(name: str, kept: DataFrame, mapping: dict[str, tuple[str, str]], carried: Iterable[str] = ()) -> Member:
    present = [n for n in mapping if n in kept.columns]
    rows = kept.select("pos", *carried, *[F.col(n).alias(mapping[n][0]) for n in present])
    return Member(name, rows, {mapping[n][0]: mapping[n][1] for n in present}, tuple(carried))


def union_types(members: list[Member]) -> dict[str, str]:
    """Columns in first-seen order with their first-seen type."""
    out: dict[str, str] = {}
    for m in members:
        for c, t in m.types.items():
            out.setdefault(c, t)
    return out


def union_members(members: list[Member]) -> tuple[DataFrame, dict[str, str]]:
    """Stack the members, converting each column to its first-seen type; missing columns are NULL."""
    types = union_types(members)
    carried = list(dict.fromkeys(c for m in members for c in m.carried))
    out = None
    for i, m in enumerate(members):
        have = {f.name: f.dataType for f in m.rows.schema.fields}
        columns = [
            (coerce(F.col(c), t, have[c]) if c in have else F.lit(None).cast(storage_type(t))).alias(c) for c, t in types.items()
        ]
        part = m.rows.select(F.lit(i).alias("member_no"), F.lit(m.name).alias("member"), "pos", *[(F.col(c) if c in m.carried else F.lit(None)).alias(c) for c in carried], *columns)
        out = part if out is None else out.unionByName(part)
    return out, types


def check_registry(columns: DataFrame, registry: DataFrame) -> DataFrame:
    """How far the registry covers ``columns(table_name, column_name)``: counts, new names, verdict."""
    known = registry.select(F.col("name").alias("column_name"), F.lit(True).alias("known"))
    seen = columns.select("table_name", "column_name").distinct().join(known, "column_name", "left")
    new = F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("column_name"))))
    return seen.groupBy("table_name").agg(
        F.count("known").alias("known_entities"),
        F.count_if(F.col("known").isNull()).alias("new_entities"),
        F.array_join(new, ", ").alias("new"),
    ).select(
        "table_name", F.lit(True).alias("passed"), "known_entities", "new_entities",
        F.when(F.col("new") == "", "none").otherwise(F.col("new")).alias("new"),
        F.when(F.col("new_entities") > 0, "extends registry").otherwise("fully covered").alias("verdict"),
    )


def check_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """Columns added to and removed from each table since the stored schema ``before(table_name, column_name)``."""
    both = (
        now.select("table_name", "column_name", F.lit(1).alias("now")).distinct()
        .join(before.select("table_name", "column_name", F.lit(1).alias("before")).distinct(), ["table_name", "column_name"], "full")
    )
    per_table = both.groupBy("table_name").agg(
        F.count("before").alias("n_before"), F.count("now").alias("n_now"),
        F.array_sort(F.collect_list(F.when(F.col("before").isNull(), F.col("column_name")))).alias("added"),
        F.array_sort(F.collect_list(F.when(F.col("now").isNull(), F.col("column_name")))).alias("removed"),
    ).filter(F.col("n_now") > 0)
    first = F.col("n_before") == 0
    added = F.when(first, F.array().cast("array<string>")).otherwise(F.col("added"))
    return per_table.withColumn("added", added).select(
        "table_name", (F.size("removed") == 0).alias("passed"), F.when(first, 0).otherwise(1).alias("baseline_uploads"),
        F.when(F.size("added") > 0, F.array_join("added", ", ")).otherwise("none").alias("added"),
        F.when(F.size("removed") > 0, F.array_join("removed", ", ")).otherwise("none").alias("removed"),
        F.when(first, "first upload").when(F.size("removed") > 0, "breaking (columns removed)")
        .when(F.size("added") > 0, "new columns added").otherwise("stable").alias("drift"),
    )
