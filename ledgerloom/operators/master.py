"""Golden records: natural keys, canonical names, attributes, the fuzzy fold, lookups and enrichment.

Rows carry ``source_table`` and ``pos`` (their order). They are reduced to one row per (key, name,
id, source) before anything else moves, so a customer with a third of all rows costs little.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgerloom.functions.text import blank_to_null, is_blank, norm_name
from ledgerloom.operators.fold import fold_names
from ledgerloom.session import durable


@dataclass(frozen=True)
class EntitySpec:
    name: str
    id_column: str | None
    name_column: str
    attributes: tuple[str, ...]


# The mastered entities and the columns they are read from.
SPECS = {
    "customer": EntitySpec("customer", "customer_id", "customer",
                           ("region", "channel", "sales_rep", "address_1", "city", "postal_code")),
    "product": EntitySpec("product", "product_code", "product",
                          ("unit_size", "bottle_size", "unit_price", "vendor", "package_format")),
    "vendor": EntitySpec("vendor", None, "vendor", ("region",)),
}
NAME_ONLY = "name:"


def _column(df: DataFrame, name: str | None) -> Column:
    return blank_to_null(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")


def instances(rows: DataFrame, spec: EntitySpec) -> DataFrame:
    """One row per (key, name, id, source): count, first position and first value of each attribute."""
    id_, name = _column(rows, spec.id_column), _column(rows, spec.name_column)
    present = [a for a in spec.attributes if a in rows.columns]
    used = rows.select(
        name.alias("name"), id_.alias("id"), "source_table", "pos", *[_column(rows, a).alias(f"a_{a}") for a in present]
    ).filter(F.col("id").isNotNull() | F.col("name").isNotNull())
    firsts = [F.min(F.when(F.col(f"a_{a}").isNotNull(), F.struct("pos", F.col(f"a_{a}").alias("v")))).alias(f"a_{a}") for a in present]
    found = used.groupBy("name", "id", "source_table").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), *firsts)
    # The key hangs on id and name, so it is made for each of their couples, not for each row.
    key = F.when(F.col("id").isNotNull(), norm_name(F.col("id"))).otherwise(F.concat(F.lit(NAME_ONLY), norm_name(F.col("name"))))
    return found.select(key.alias("key"), *found.columns)


def name_counts(inst: DataFrame) -> DataFrame:
    """One row per (key, name) with its ids, sources, count and first values."""
    attrs = [c for c in inst.columns if c.startswith("a_")]
    return inst.groupBy("key", "name").agg(
        F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), F.collect_set("id").alias("ids"),
        F.collect_set("source_table").alias("sources"), *[F.min(a).alias(a) for a in attrs],
    )


def buckets(inst: DataFrame) -> DataFrame:
    """One row per natural key, before the fold."""
    return inst.groupBy("key").agg(
        F.sum("n").alias("instance_count"), F.array_sort(F.collect_set("id")).alias("ids"),
        F.array_sort(F.collect_set("source_table")).alias("sources"), F.min("first_pos").alias("first_pos"),
    )


def canonical_names(counts: DataFrame) -> DataFrame:
    """Most frequent name of each key, then the longest, then the first seen."""
    order = F.struct((-F.col("n")).alias("n"), (-F.length("name")).alias("l"), "first_pos")
    return counts.filter(F.col("name").isNotNull()).groupBy("key").agg(F.min_by("name", order).alias("name"))


def first_attributes(inst: DataFrame) -> DataFrame:
    attrs = [c for c in inst.columns if c.startswith("a_")]
    return inst.groupBy("key").agg(*[F.min(a)["v"].alias(a[2:]) for a in attrs])


def fold_map(counts: DataFrame) -> DataFrame:
    """Absorbed name-only keys and their roots. Names are those of the keys, fixed before the fold."""
    named = counts.filter(F.col("key").startswith(NAME_ONLY)).groupBy("key").agg(F.min("first_pos").alias("first_pos"))
    return fold_names(named.withColumn("name", F.col("key").substr(len(NAME_ONLY) + 1, 1_000_000_000)))


def golden_id(entity: str, key: Column) -> Column:
    return F.concat(F.lit(entity[:3] + "_"), F.substring(F.sha1(F.concat(F.lit(entity + ":"), key)), 1, 10))


def unique_ids(records: DataFrame, entity: str) -> DataFrame:
    """``golden_id`` in front. Ids have 40 bits; of keys that share one the first keeps it, others get their whole digest."""
    short = golden_id(entity, F.col("key"))
    turn = F.row_number().over(Window.partitionBy("_id").orderBy("key"))
    whole = F.concat(F.lit(entity[:3] + "_"), F.sha1(F.concat(F.lit(entity + ":"), F.col("key"))))
    numbered = records.withColumn("_id", short).withColumn("_turn", turn)
    return numbered.select(F.when(F.col("_turn") == 1, F.col("_id")).otherwise(whole).alias("golden_id"), *records.columns)


@dataclass
class Golden:
    """Golden records without lists, and what belongs to them as rows of its own.

    records: golden_id, key, name, attributes, instance_count, first_pos. ids, names, sources: golden_id and one distinct
    id, spelling or source table.
    """

    entity: str
    records: DataFrame
    ids: DataFrame
    names: DataFrame
    sources: DataFrame


def golden(inst: DataFrame, entity: str, fold: bool = True) -> Golden:
    """One record per real-world entity, from instances in any number of parts.

    Instances of several uploads can be put together: counts add up, the first position and value is the least.
    """
    spec = SPECS[entity]
    attrs = [c for c in inst.columns if c.startswith("a_")]
    counts = inst.groupBy("key", "name").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), *[F.min(a).alias(a) for a in attrs])
    if fold:
        counts = durable(counts, f"{entity}-names")
        taken = durable(fold_map(counts).select("key", "root", F.col("first_pos").alias("bucket_pos")), f"{entity}-folds")
        counts = counts.join(taken, "key", "left")
    else:
        taken = None
        counts = counts.withColumns({"root": F.lit(None).cast("string"), "bucket_pos": F.lit(None).cast(counts.schema["first_pos"].dataType)})
    late = F.when(F.col("root").isNull(), 0).otherwise(1)
    counts = counts.withColumns({"late": late, "key": F.coalesce("root", "key")})
    by_name = F.when(
        F.col("name").isNotNull(),
        F.struct((-F.col("n")).alias("n"), (-F.length("name")).alias("l"), "late", "bucket_pos", "first_pos", "name"),
    )
    # The root's own value comes first, then those of absorbed buckets in their order.
    value = {a: F.when(F.col(a).isNotNull(), F.struct("late", "bucket_pos", F.col(a).alias("x"))) for a in attrs}
    merged = counts.groupBy("key").agg(
        F.coalesce(F.min(by_name)["name"], F.lit("")).alias("name"), *[F.min(v)["x"]["v"].alias(a[2:]) for a, v in value.items()],
        F.sum("n").alias("instance_count"), F.min(F.when(F.col("late") == 0, F.col("first_pos"))).alias("first_pos"),
    )
    missing = {a: F.lit(None).cast("string") for a in spec.attributes if f"a_{a}" not in attrs}
    records = durable(unique_ids(merged.withColumns(missing).select("key", "name", *spec.attributes, "instance_count", "first_pos"), entity), f"{entity}-records")

    def children(column: str, out: str) -> DataFrame:
        """Distinct values of the instances behind each record; reduced before they meet the records."""
        each = inst.filter(F.col(column).isNotNull()).select("key", F.col(column).alias(out)).distinct()
        if taken is not None:
            each = each.join(taken.select("key", "root"), "key", "left").select(F.coalesce("root", "key").alias("key"), out).distinct()
        return each.join(records.select("key", "golden_id"), "key").select("golden_id", out)

    return Golden(entity, records, children("id", "id"), children("name", "name"), children("source_table", "source"))


def listed(g: Golden) -> DataFrame:
    """Records with lists of their distinct ids, spellings and sources, for presentation."""

    def lists(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.groupBy("golden_id").agg(F.array_sort(F.collect_list(column)).alias(out))

    none = F.array().cast("array<string>")
    out = g.records.join(lists(g.ids, "id", "ids"), "golden_id", "left").join(lists(g.names, "name", "name_variants"), "golden_id", "left").join(lists(g.sources, "source", "sources"), "golden_id", "left")
    return out.select(
        "golden_id", "key", "name", *[F.coalesce(c, none).alias(c) for c in ("ids", "name_variants", "sources")], *SPECS[g.entity].attributes, "instance_count", "first_pos"
    )


def golden_records(rows: DataFrame, entity: str, fold: bool = True) -> DataFrame:
    """One row per real-world entity.

    ``golden_id, key, name, ids, name_variants, sources, attributes..., instance_count, first_pos``;
    the lists hold distinct values only. ``record_order`` gives the presentation order.
    """
    return listed(golden(durable(instances(rows, SPECS[entity]), f"{entity}-instances"), entity, fold))


def record_order() -> list[Column]:
    """Most instances first, then by name, then first seen."""
    return [F.desc("instance_count"), F.asc("name"), F.asc("first_pos")]


def _last_wins() -> Column:
    return F.struct((-F.col("instance_count")).alias("c"), "name", "first_pos")


def _last_of(g: Golden, each: DataFrame, key: str) -> DataFrame:
    """Of several records with one key the last in presentation order wins."""
    order = g.records.select("golden_id", _last_wins().alias("o"))
    return each.join(order, "golden_id").groupBy(key).agg(F.max_by("golden_id", "o").alias("golden_id"))


def id_index(g: Golden) -> DataFrame:
    """Raw id -> golden id."""
    return _last_of(g, g.ids, "id")


def name_index(g: Golden) -> DataFrame:
    """Normalised name -> golden id."""
    return _last_of(g, g.names.select("golden_id", norm_name(F.col("name")).alias("name_form")), "name_form")


@dataclass
class Index:
    """Lookup tables of one entity, written out so that their size is known when they are joined."""

    ids: DataFrame | None
    names: DataFrame

    @classmethod
    def of(cls, g: Golden) -> Index:
        """From the rows of ids and spellings."""
        ids = durable(id_index(g), f"{g.entity}-ids") if SPECS[g.entity].id_column else None
        return cls(ids, durable(name_index(g), f"{g.entity}-name-index"))


#: Numbers for rows without id and name, which match nothing; no couple has one of them.
SPREAD = 4096


def _couple(id_: Column, name: Column, seed: int) -> Column:
    """A number for id and name together; NULL when both are missing."""
    none = F.lit("")
    number = F.xxhash64(F.lit(seed), id_.isNull(), F.coalesce(id_, none), name.isNull(), F.coalesce(name, none))
    return F.when(id_.isNotNull() | name.isNotNull(), number)


def _bytes_of(golden_id: Column) -> Column:
    return F.unhex(F.substring(golden_id, 5, 1000))


def _id_of(entity: str, digits: Column) -> Column:
    return F.concat(F.lit(entity[:3] + "_"), F.lower(F.hex(digits)))


def known_couples(rows: DataFrame, entity: str, index: Index) -> tuple[DataFrame, int]:
    """``_couple, _found``: the golden id of every distinct couple of id and name that has one, under its number, and the seed of the numbers.

    By id, else by name. Couples are much fewer than rows. Where two numbers are equal, all are made anew with another seed.
    Ids are kept as bytes if all of the index can be; the type of ``_found`` tells.
    """
    spec = SPECS[entity]
    id_, name = _column(rows, spec.id_column), _column(rows, spec.name_column)
    each = durable(rows.select(id_.alias("id"), name.alias("name")).filter(F.col("id").isNotNull() | F.col("name").isNotNull()).distinct(), f"{entity}-couples")
    seed = 0
    while True:
        numbers = each.groupBy(_couple(F.col("id"), F.col("name"), seed).alias("c")).agg(F.count(F.lit(1)).alias("n"))
        if numbers.filter((F.col("n") > 1) | F.col("c").between(0, SPREAD - 1)).isEmpty():
            break
        seed += 1
    found = each.select(_couple(F.col("id"), F.col("name"), seed).alias("_couple"), "id", norm_name(F.col("name")).alias("name_form"))
    by_id = F.lit(None).cast("string")
    if index.ids is not None and spec.id_column in rows.columns:
        found = found.join(index.ids.select("id", F.col("golden_id").alias("_by_id")), "id", "left")
        by_id = F.col("_by_id")
    found = found.join(index.names.select("name_form", F.col("golden_id").alias("_by_name")), "name_form", "left")
    known = found.select("_couple", F.coalesce(by_id, F.col("_by_name")).alias("_found")).filter(F.col("_found").isNotNull())
    told = F.col("golden_id")
    if all(t.filter(~_id_of(entity, _bytes_of(told)).eqNullSafe(told)).isEmpty() for t in (index.ids, index.names) if t is not None):
        known = known.withColumn("_found", _bytes_of(F.col("_found")))
    return durable(known, f"{entity}-known"), seed


def short_lookups(rows: DataFrame, indexes: dict[str, Index]) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with ``<entity>_golden_id`` for each entity, short, and the columns that write them out: by id, else by name; NULL when neither is known.

    Each distinct couple of id and name is looked up once, and a row meets one number for each entity. All numbers are made before
    the first join, so texts that nobody uses later do not travel; golden ids travel as bytes. Spark broadcasts known couples below
    its size threshold. Beyond it the join shuffles, rows without a key are spread, and adaptive execution splits couples shared by very many rows.
    """
    found, tables, written = rows, {}, {}
    for entity, index in indexes.items():
        spec = SPECS[entity]
        tables[entity], seed = known_couples(rows, entity, index)
        couple = _couple(_column(rows, spec.id_column), _column(rows, spec.name_column), seed)
        # Rows without a key must not meet in one task.
        found = found.withColumn(f"_{entity}", F.coalesce(couple, F.pmod(F.xxhash64("pos"), F.lit(SPREAD))))
    for entity, known in tables.items():
        key, out = f"_{entity}", f"{entity}_golden_id"
        written[out] = _id_of(entity, F.col(out)) if isinstance(known.schema["_found"].dataType, T.BinaryType) else F.col(out)
        found = found.join(known.select(F.col("_couple").alias(key), F.col("_found").alias(out)), key, "left").drop(key)
    return found, written


def lookups(rows: DataFrame, indexes: dict[str, Index]) -> DataFrame:
    """``rows`` with the golden id of each entity; see :func:`short_lookups`."""
    found, written = short_lookups(rows, indexes)
    return found.withColumns(written)


def enrich_rows(rows: DataFrame, indexes: dict[str, Index]) -> DataFrame:
    """Attach golden customer and product ids."""
    return lookups(rows, {entity: indexes[entity] for entity in ("customer", "product")})


def master_summary(golden: dict[str, DataFrame]) -> DataFrame:
    """Number of golden records per entity."""
    out = None
    for entity, records in golden.items():
        one = records.agg(F.count(F.lit(1)).alias("record_count")).select(F.lit(entity).alias("entity"), "record_count")
        out = one if out is None else out.unionByName(one)
    return out


__all__ = [
    "Golden", "Index", "SPECS", "EntitySpec", "buckets", "canonical_names", "enrich_rows", "first_attributes", "fold_map", "golden",
    "golden_id", "golden_records", "id_index", "instances", "is_blank", "known_couples", "listed", "lookups", "master_summary", "name_counts", "name_index",
    "record_order", "short_lookups", "unique_ids",
]
