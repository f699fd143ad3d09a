"""Registry of canonical business entities and confirmations that extend it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions.text import norm_name, strip

SCHEMA = "ord int, name string, role string, type string, expect string, aliases array<string>"

# The entities every new registry starts with, and the titles known for them.
SEED: list[dict] = [
    {"name": "order_date", "role": "timestamp", "type": "date", "expect": "date",
     "aliases": ["date", "order date", "delivery date", "sale date", "transaction date", "period", "event date",
                 "event timestamp"]},
    {"name": "customer", "role": "dimension", "type": "string", "expect": "text",
     "aliases": ["customer", "customer name", "cust name", "custname", "account", "account name", "buyer", "client",
                 "store", "outlet", "ship to"]},
    {"name": "customer_id", "role": "id", "type": "string", "expect": "id",
     "aliases": ["customer id", "customer code", "customer key", "account id", "account code", "account number",
                 "cust id", "customer group id"]},
    {"name": "product", "role": "dimension", "type": "string", "expect": "text",
     "aliases": ["product", "item", "description", "product description", "wine", "product name", "item name", "brand"]},
    {"name": "product_code", "role": "id", "type": "string", "expect": "id",
     "aliases": ["sku", "upc", "ean", "gtin", "barcode", "product code", "item code", "supplier's sku", "code",
                 "product key"]},
    {"name": "quantity", "role": "measure", "type": "decimal", "expect": "number",
     "aliases": ["qty", "quantity", "units", "cases", "sold", "number of sales", "qty sold", "qty ordered",
                 "quantity ordered", "cases ordered", "ordered", "units ordered"]},
    {"name": "unit_price", "role": "measure", "type": "decimal", "expect": "number",
     "aliases": ["price", "unit price", "fob", "msrp", "unit msrp", "cost", "default selling price"]},
    {"name": "amount", "role": "measure", "type": "decimal", "expect": "number",
     "aliases": ["amount", "total", "net sales", "gross sales", "revenue", "dollars sold", "extended", "sale amount",
                 "sale msrp", "line total"]},
    {"name": "region", "role": "dimension", "type": "string", "expect": "text",
     "aliases": ["state", "region", "account region", "market", "territory", "cust sales market", "province"]},
    {"name": "postal_code", "role": "id", "type": "string", "expect": "id",
     "aliases": ["zip", "zip code", "zipcode", "postal", "postal code", "post code"]},
    {"name": "sales_rep", "role": "dimension", "type": "string", "expect": "text",
     "aliases": ["sales rep", "salesperson", "rep", "sales representative", "rep code", "account rep"]},
    {"name": "channel", "role": "dimension", "type": "string", "expect": "text",
     "aliases": ["division", "channel", "premise", "on premise", "off premise", "account type", "customer division"]},
    {"name": "vendor", "role": "dimension", "type": "string", "expect": "text",
     "aliases": ["importer", "supplier", "supplier name", "distributor", "vendor", "data vendor"]},
]


def registry_frame(spark: SparkSession, registry: list[dict] = SEED) -> DataFrame:
    rows = [(i, e["name"], e.get("role"), e.get("type"), e.get("expect"), list(e.get("aliases", []))) for i, e in enumerate(registry)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def read_registry(spark: SparkSession, path: str | None = None) -> list[dict]:
    """Persisted registry, or the seed when none was written yet. It is a specification of a few rows."""
    if path is None:
        return [dict(e) for e in SEED]
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return [dict(e) for e in SEED]
    return [r.asDict() for r in spark.read.schema(SCHEMA).json(path).orderBy(F.col("ord").asc_nulls_last(), "name").collect()]


def write_registry(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").json(path, ignoreNullFields=False)


def confirm_aliases(registry: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Add confirmed titles ``(pos, source, entity, role, type, expect)`` as aliases.

    New entities follow the known ones (``ord``), in the order in which they were first confirmed.

    An unknown entity becomes a new one. A title is stored once per normal form, spelled as first
    confirmed, and only when it differs from the entity's own name and known aliases.
    """
    usable = confirmations.filter((F.coalesce("source", F.lit("")) != "") & (F.coalesce("entity", F.lit("")) != ""))
    entities = usable.groupBy("entity").agg(
        F.min("pos").alias("first_pos"), *[F.min_by(c, "pos").alias(c) for c in ("role", "type", "expect")]
    )
    known = registry.select(F.col("name").alias("entity"), F.explode(F.transform("aliases", norm_name)).alias("form"))
    fresh = (
        usable.withColumn("form", norm_name(F.col("source")))
        .filter((F.col("form") != "") & (F.col("form") != norm_name(F.col("entity"))))
        .groupBy("entity", "form")
        .agg(F.min("pos").alias("pos"), F.min_by(F.lower(strip(F.col("source"))), "pos").alias("alias"))
        .join(known, ["entity", "form"], "left_anti")
    )
    added = fresh.groupBy("entity").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias"))), lambda s: s["alias"]).alias("added")
    )
    new = entities.join(registry, entities["entity"] == registry["name"], "left_anti").select(
        F.lit(None).cast("int").alias("ord"), F.col("entity").alias("name"),
        F.coalesce("role", F.lit("dimension")).alias("role"), F.coalesce("type", F.lit("string")).alias("type"),
        F.coalesce("expect", F.lit("text")).alias("expect"), F.array().cast("array<string>").alias("aliases"), "first_pos",
    )
    both = registry.withColumn("first_pos", F.lit(None).cast(entities.schema["first_pos"].dataType)).unionByName(new)
    # new entities are a few names that people confirmed, never rows of data
    last = registry.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    rank = new.select(F.col("name").alias("new_name"), F.row_number().over(Window.orderBy("first_pos", "name")).alias("rank"))
    placed = both.join(rank, both["name"] == rank["new_name"], "left").join(last).withColumn("ord", F.coalesce("ord", F.col("last") + F.col("rank")))
    return placed.join(added, placed["name"] == added["entity"], "left").select(
        "ord", "first_pos", "name", "role", "type", "expect",
        F.concat("aliases", F.coalesce("added", F.array().cast("array<string>"))).alias("aliases"),
    )
