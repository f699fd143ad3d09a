"""The fixed star: customer, product and vendor dimensions and the sales fact."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerloom.functions.casts import coerce
from ledgerloom.operators.master import SPECS, Golden, Index, golden as make_golden, instances, short_lookups
from ledgerloom.operators.numbering import block_starts, numbered, numbered_in_blocks
from ledgerloom.session import COMPRESSION, durable

FOREIGN_KEYS = {
    "customer_golden_id": "dim_customer", "product_golden_id": "dim_product", "vendor_golden_id": "dim_vendor",
}
HARVESTED = [
    "customer_id", "customer", "product_code", "product", "vendor", "region", "channel", "sales_rep", "address_1", "city",
    "postal_code", "unit_size", "bottle_size", "unit_price", "package_format", "order_date", "quantity", "amount",
]


class ForeignKeyError(ValueError):
    """A fact refers to a dimension row that does not exist."""


def dimensions(golden: dict[str, Golden]) -> dict[str, DataFrame]:
    """The three dimensions from records and their rows of ids and sources."""

    def with_sources(g: Golden) -> DataFrame:
        """The names of the source tables, as many as there are tables at most."""
        told = g.sources.groupBy("golden_id").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))
        return g.records.join(told, "golden_id", "left")

    codes = golden["product"].ids.groupBy("golden_id").agg(F.min("id").alias("product_code"))
    return {
        "dim_customer": with_sources(golden["customer"]).select("golden_id", "name", "region", "channel", "sales_rep", "address_1", "city", "postal_code", "sources"),
        "dim_product": with_sources(golden["product"]).join(codes, "golden_id", "left").select("golden_id", "name", "product_code", "unit_size", "bottle_size", "vendor", "sources"),
        "dim_vendor": with_sources(golden["vendor"]).select("golden_id", "name", "sources"),
    }


def fact_sales(rows: DataFrame, indexes: dict[str, Index], carried: Iterable[str] = ()) -> DataFrame:
    """Fact rows with golden keys; ``fact_id`` numbers them 1..n in the order of ``pos``. ``carried`` columns of ``rows`` stay."""
    types = {f.name: f.dataType for f in rows.schema.fields}

    def number(name: str):
        return (coerce(F.col(name), "number", types[name]) if name in types else F.lit(None).cast("double")).alias(name)

    def text(name: str):
        return (F.col(name) if name in types else F.lit(None).cast("string")).alias(name)

    keyed, written = short_lookups(rows, {entity: indexes[entity] for entity in ("customer", "product", "vendor")})
    facts = keyed.select(
        "pos", text("upload_id"), "source_table", text("order_date"), number("quantity"), number("amount"), number("unit_price"),
        text("channel"), text("region"), "customer_golden_id", "product_golden_id", "vendor_golden_id", *carried,
    )
    if isinstance(types["pos"], T.IntegralType):
        # each row finds at most one golden id of an entity, so the rows to be numbered are those that came
        done = numbered_in_blocks(facts, "pos", "fact_id", block_starts(rows.select("pos")))
    else:
        done = numbered(facts, [F.asc("pos")], "fact_id")
    return done.select("fact_id", *[written[c].alias(c) if c in written else c for c in facts.columns])


def fk_violations(fact: DataFrame, dims: dict[str, DataFrame], keys: dict[str, str] | None = None) -> DataFrame:
    """Fact rows per foreign key that have a key without a parent. The keys are counted, in one pass, before they meet the dimensions."""
    keys = keys or FOREIGN_KEYS
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("foreign_key"), F.col(k).cast("string").alias("golden_id")) for k in keys]))
    used = fact.select(told.alias("k")).select("k.*").filter(F.col("golden_id").isNotNull()).groupBy("foreign_key", "golden_id").agg(F.count(F.lit(1)).alias("n"))
    parents, named = None, None
    for column, dim in keys.items():
        one = dims[dim].select(F.lit(column).alias("foreign_key"), F.col("golden_id").cast("string").alias("golden_id"))
        parents = one if parents is None else parents.unionByName(one)
        name = fact.sparkSession.range(0, 1, 1, 1).select(F.lit(column).alias("foreign_key"), F.lit(dim).alias("references"))
        named = name if named is None else named.unionByName(name)
    lost = used.join(parents, ["foreign_key", "golden_id"], "left_anti").groupBy("foreign_key").agg(F.sum("n").alias("n"))
    return named.join(lost, "foreign_key", "left").select("foreign_key", "references", F.coalesce("n", F.lit(0)).alias("violations"))


@dataclass
class Star:
    dim_customer: DataFrame
    dim_product: DataFrame
    dim_vendor: DataFrame
    fact_sales: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"dim_customer": self.dim_customer, "dim_product": self.dim_product, "dim_vendor": self.dim_vendor, "fact_sales": self.fact_sales}

    def counts(self) -> DataFrame:
        out = None
        for name, df in self.tables().items():
            one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            out = one if out is None else out.unionByName(one)
        return out


def build_star(rows: DataFrame, fact_tables: list[str], golden: dict[str, Golden] | None = None) -> Star:
    """Dimensions from golden records of all rows, facts from the rows of the fact tables.

    ``rows`` is the staging harvest. It is read once per entity with only that entity's columns, unless the records are
    given (see ``plans.mastering``); then it needs the rows of the fact tables only.
    """
    if golden is None:
        golden = {e: make_golden(durable(instances(rows, SPECS[e]), f"{e}-instances"), e) for e in SPECS}
    indexes = {e: Index.of(g) for e, g in golden.items()}
    facts = fact_sales(rows.filter(F.col("source_table").isin(fact_tables)), indexes)
    return Star(**dimensions(golden), fact_sales=facts)


def publish(star: Star, root: str) -> str:
    """Write all four tables as a new version, check the foreign keys, then point to it.

    Readers see the old version until the pointer moves, so a failed rebuild leaves nothing half done.
    """
    spark: SparkSession = star.fact_sales.sparkSession
    stamp = spark.range(0, 1, 1, 1).select(F.expr("uuid()").alias("u")).first()["u"].replace("-", "")
    base = f"{root}/star/v_{stamp}"
    for name, df in star.tables().items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}", compression=COMPRESSION)
    stored = {name: spark.read.parquet(f"{base}/{name}") for name in star.tables()}
    bad = [r for r in fk_violations(stored["fact_sales"], stored).collect() if r["violations"]]
    if bad:
        raise ForeignKeyError(", ".join(f"{r['foreign_key']}: {r['violations']} rows without {r['references']}" for r in bad))
    spark.createDataFrame([(base,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root}/star/current")
    return base


def read_star(spark: SparkSession, root: str) -> Star:
    base = spark.read.schema("path string").json(f"{root}/star/current").first()["path"]
    return Star(*[spark.read.parquet(f"{base}/{t}") for t in ("dim_customer", "dim_product", "dim_vendor", "fact_sales")])


def sales_view(star: Star, limit: int | None = None) -> DataFrame:
    """Facts with their dimensions, ordered by their ids; the first ``limit`` of them, or all."""
    fact = star.fact_sales if limit is None else star.fact_sales.filter(F.col("fact_id") <= limit)
    c = star.dim_customer.select(F.col("golden_id").alias("customer_golden_id"), F.col("name").alias("customer"), F.col("region").alias("c_region"), F.col("channel").alias("c_channel"))
    p = star.dim_product.select(F.col("golden_id").alias("product_golden_id"), F.col("name").alias("product"), "product_code")
    v = star.dim_vendor.select(F.col("golden_id").alias("vendor_golden_id"), F.col("name").alias("vendor"))
    return (
        fact.join(c, "customer_golden_id", "left").join(p, "product_golden_id", "left").join(v, "vendor_golden_id", "left")
        .select("fact_id", "pos", "order_date", "quantity", "amount", "source_table", "customer", F.col("c_region").alias("region"),
                F.col("c_channel").alias("channel"), "product", "product_code", "vendor")
        .orderBy("fact_id")
    )
