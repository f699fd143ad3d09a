"""Group sheets that describe the same kind of rows, and name the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.text import snake
from ledgerloom.session import durable


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: each node with the smallest id it is connected to.

    Labels spread along the edges and then jump to the label of their label, so a chain of n nodes
    takes about log n rounds. Each round is written out, which keeps the plan short.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = nodes.select("id", F.col("id").alias("label"))
    if both.isEmpty():
        return labels.withColumnRenamed("label", "component")
    labels = durable(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("before"))
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = durable(
            spread.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "before"), "labels"
        )
        labels = after.select("id", "label")
        if after.filter(F.col("label") != F.col("before")).isEmpty():
            return labels.withColumnRenamed("label", "component")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of distinct entity sets of one file with Jaccard similarity >= threshold.

    Elements are ordered by how rare they are and each set is indexed by its first
    ``n - ceil(threshold * n) + 1`` elements only: two sets that are similar enough must share one
    of these. Sets, not sheets, are compared, so a schema shared by many sheets counts once.
    """
    n = F.size("entities")
    element = sets.filter(n > 0).select("file", "id", "entities", F.explode("entities").alias("entity"))
    rarity = element.groupBy("file", "entity").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("file", "id").orderBy("df", "entity"))  # bounded by the registry
    prefix = (
        element.join(rarity, ["file", "entity"])
        .withColumn("rank", rank)
        .filter(F.col("rank") <= n - F.ceil(n * F.lit(threshold)) + 1)
        .select("file", "entity", "id", "entities")
    )
    left = prefix.select("file", "entity", F.col("id").alias("a"), F.col("entities").alias("ea"))
    right = prefix.select("file", "entity", F.col("id").alias("b"), F.col("entities").alias("eb"))
    na, nb = F.size("ea"), F.size("eb")
    both = F.size(F.array_intersect("ea", "eb"))
    return (
        left.join(right, ["file", "entity"])
        .filter((F.col("a") < F.col("b")) & (F.least(na, nb) >= F.greatest(na, nb) * threshold))
        .filter(both / (na + nb - both) >= threshold)
        .select("a", "b")
        .distinct()
    )


def union_groups(sets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One row per (file, sheet) with its group: ``file, sheet, entities, group_id``.

    Input is ``entity_sets``. Sheets without entities stay alone.
    """
    keyed = sets.withColumn("file_set", F.concat_ws("\x1f", "file", F.array_join("entities", "\x1e"))).withColumn(
        "id",
        F.when(F.size("entities") > 0, F.sha2("file_set", 256)).otherwise(F.sha2(F.concat_ws("\x1f", "file", "sheet", F.lit("alone")), 256)),
    )
    distinct_sets = durable(keyed.groupBy("id").agg(F.first("file").alias("file"), F.first("entities").alias("entities")), "entity-sets")
    component = connected_components(distinct_sets, similar_sets(distinct_sets, threshold))
    return keyed.join(component, "id").select("file", "sheet", "entities", F.col("component").alias("group_id"))


def name_groups(groups: DataFrame) -> DataFrame:
    """One row per group: table name, first member, number of members, shared entities, reason.

    Names come from the shared entities; a repeated name gets ``_2``, ``_3`` in first-member order.
    """
    sizes = groups.groupBy("file", "group_id").agg(F.count(F.lit(1)).alias("members"), F.min("sheet").alias("first_sheet"))
    held = groups.select("file", "group_id", F.explode("entities").alias("entity")).groupBy("file", "group_id", "entity").agg(
        F.count(F.lit(1)).alias("holders")
    )
    shared = (
        held.join(sizes.select("file", "group_id", "members"), ["file", "group_id"])
        .filter(F.col("holders") == F.col("members"))
        .groupBy("file", "group_id")
        .agg(F.array_sort(F.collect_list("entity")).alias("shared"))
    )
    named = sizes.join(shared, ["file", "group_id"], "left").withColumn(
        "shared", F.coalesce("shared", F.array().cast("array<string>"))
    )

    def has(e: str):
        return F.array_contains("shared", e)

    base = (
        F.when(has("amount") | (has("quantity") & has("customer_id")), "sales")
        .when(has("customer") & ~has("product"), "customers")
        .when(has("product"), "products")
        .when(has("vendor"), "vendors")
        .otherwise(snake(F.col("first_sheet")))
    )
    turn = F.row_number().over(Window.partitionBy("file", "base").orderBy("first_sheet"))
    numbered = named.withColumn("base", base).withColumn("turn", turn)
    return numbered.select(
        "file", "group_id",
        F.when(F.col("turn") > 1, F.concat_ws("_", "base", F.col("turn").cast("string"))).otherwise(F.col("base")).alias("table_name"),
        "first_sheet", "members", "shared", (F.col("members") > 1).alias("is_union"),
        F.when(F.col("members") > 1, F.concat(F.lit("share "), F.size("shared").cast("string"), F.lit(" canonical entities")))
        .otherwise("distinct schema").alias("reason"),
    )
