"""A star declared by a specification: created or widened, loaded per upload, and checked.

The specification is two small lists, ``tables(table, kind, natural_key, source_sheets)`` and
``columns(table, name, type, role, source, references)``; ``source`` is ``sheet.column`` and
``references`` is ``table.column``. Loading is set based: one aggregate finds the new rows of a
dimension and one join per foreign key resolves all facts. The source rows are written once, with their place as a number.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerloom.functions.casts import coerce, storage_type
from ledgerloom.operators.numbering import numbered
from ledgerloom.operators.siblings import Tab
from ledgerloom.session import durable, observed
from ledgerloom.sources.staging import Store

UPLOAD = "_upload_id"
BUCKET = "_bucket"
#: Folders a dimension's rows are dealt into. Part of the stored layout, so it must stay as it is for a given store.
BUCKETS = 64
#: Bits of a row's place in its sheet, and of its place in a fact's sheets.
AT_BITS, PLACE_BITS = 41, 54


@dataclass
class StarSpec:
    tables: list[dict]
    columns: list[dict]
    _by_table: dict[str, list[dict]] = field(init=False)

    def __post_init__(self):
        self._by_table = {}
        for c in self.columns:
            self._by_table.setdefault(c["table"], []).append(c)

    def of(self, table: str) -> list[dict]:
        return self._by_table.get(table, [])

    def dimensions(self) -> list[dict]:
        return [t for t in self.tables if t["kind"] == "dimension"]

    def facts(self) -> list[dict]:
        return [t for t in self.tables if t["kind"] != "dimension"]

    def reference(self, column: dict) -> tuple[str, str] | None:
        """Referenced (table, column) of a foreign key."""
        target = column.get("references") or ""
        if column.get("role") != "fk" or "." not in target:
            return None
        table, _, name = target.partition(".")
        return table, name

    def foreign_keys(self, fact: str) -> dict[str, tuple[str, str]]:
        return {c["name"]: r for c in self.of(fact) if (r := self.reference(c))}


def source_key(column: dict) -> str:
    """Column a value is read from: the part of ``source`` after its first dot, else the own name."""
    sheet, dot, name = (column.get("source") or "").partition(".")
    return name if dot and name else column["name"]


def source_sheet(column: dict) -> str | None:
    sheet, dot, _ = (column.get("source") or "").partition(".")
    return sheet if dot else None


def star_diff(store: Store, spec: StarSpec) -> DataFrame:
    """What the specification changes: ``action`` (created, reused, altered, foreign_key) and ``object``."""
    spark = store.spark
    declared = spark.createDataFrame(
        [(t["table"], t["kind"], c["name"], c["role"], ".".join(spec.reference(c) or ()) or None) for t in spec.tables for c in spec.of(t["table"])],
        "table_name string, kind string, column_name string, role string, target string",
    )
    existing = store.all_columns()
    tables, there = declared.select("table_name").distinct(), existing.select("table_name").distinct()
    created = tables.join(there, "table_name", "left_anti")
    reused = tables.join(there, "table_name", "left_semi")
    altered = (
        declared.filter(F.col("role") != "pk").join(reused, "table_name").join(existing, ["table_name", "column_name"], "left_anti")
    )
    # A foreign key is kept only when its table exists or is created as well.
    known = tables.unionByName(there).distinct().withColumnRenamed("table_name", "parent")
    keys = (
        declared.filter((F.col("kind") != "dimension") & F.col("target").isNotNull()).join(created, "table_name")
        .withColumn("parent", F.split("target", r"\.").getItem(0)).join(known, "parent", "left_semi")
    )
    def told(df: DataFrame, action: str, what: Column) -> DataFrame:
        return df.select(F.lit(action).alias("action"), what.alias("object"))

    return (
        told(created, "created", F.col("table_name")).unionByName(told(reused, "reused", F.col("table_name")))
        .unionByName(told(altered, "altered", F.concat_ws(".", "table_name", "column_name")))
        .unionByName(told(keys, "foreign_key", F.concat(F.concat_ws(".", "table_name", "column_name"), F.lit(" -> "), "target")))
    )


def table_list(store: Store, spec: StarSpec) -> list[tuple]:
    """Stored tables with their columns, primary key and foreign keys, by name. Metadata only."""
    out = []
    for name in store.tables():
        roles = {c["name"]: c for c in spec.of(name)}
        columns = [(c, t) for c, t in store.columns(name).items() if c != UPLOAD]
        keys = [c for c, _ in columns if roles.get(c, {}).get("role") == "pk"]
        foreign = [f"{c} -> {'.'.join(r)}" for c, _ in columns if c in roles and (r := spec.reference(roles[c]))]
        out.append((name, columns, keys, foreign))
    return out


def listed_tables(spark, before: list[tuple], after: list[tuple]) -> DataFrame:
    """``phase, table_name, columns, primary_key, foreign_keys, new``: the tables before and after; ``new`` if not there before."""
    known = {t[0] for t in before}
    rows = [("before", *t, False) for t in before] + [("after", *t, t[0] not in known) for t in after]
    return spark.createDataFrame(rows, "phase string, table_name string, columns array<struct<name string, type string>>, primary_key array<string>, foreign_keys array<string>, new boolean")


def ensure_tables(store: Store, spec: StarSpec) -> None:
    """Declare new tables and columns; dimensions first, facts with their hidden upload column."""
    for t in [*spec.dimensions(), *spec.facts()]:
        types = {c["name"]: "bigint" if c["role"] in ("pk", "fk") else c["type"] for c in spec.of(t["table"])}
        store.widen(t["table"], types if t["kind"] == "dimension" else {**types, UPLOAD: "text"})


def table_schema(store: Store, table: str) -> T.StructType:
    columns = store.columns(table)
    fields = [T.StructField(c, storage_type(t)) for c, t in columns.items() if c != UPLOAD]
    if UPLOAD in columns:
        fields.append(T.StructField(UPLOAD, T.StringType()))
    return T.StructType(fields)


def read_declared(store: Store, table: str) -> DataFrame:
    """Stored rows with every declared column; columns younger than a file are NULL in it."""
    return _read(store, table).select(table_schema(store, table).names)


def _read(store: Store, table: str, bucketed: bool = False) -> DataFrame:
    schema = table_schema(store, table)
    if bucketed:
        schema = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    if not store._exists(store.data_path(table)):
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).parquet(store.data_path(table))


def _value(tab: Tab, column: dict) -> Column:
    key = source_key(column)
    have = {f.name: f.dataType for f in tab.rows.schema.fields}
    dtype = have.get(tab.keys.get(key), T.StringType())
    return coerce(tab.column(key), column.get("type") or "text", dtype)


def _natural_key(dim: dict, spec: StarSpec, known: dict[str, str]) -> list[str]:
    """Declared key columns that exist; without any, all columns together are the key."""
    key = [k for k in dim.get("natural_key") or [] if k in known]
    return key or [c["name"] for c in spec.of(dim["table"]) if c["role"] != "pk" and c["name"] in known]


def _filled(columns: list[Column]) -> Column:
    """Whether a natural key has any value; rows without one have no dimension row."""
    return F.coalesce(*[c.cast("string") for c in columns]).isNotNull()


def _hash(columns: list[Column], *first: Column) -> Column:
    """64-bit hash of typed values that tells a gap from a value in every place."""
    return F.xxhash64(*first, *[x for c in columns for x in (c.isNull(), c)])


def _bucket(columns: list[Column]) -> Column:
    return F.pmod(_hash(columns), F.lit(BUCKETS)).cast("int")


def _same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality in every place: equal gaps are equal keys."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out &= a.eqNullSafe(b)
    return out


def _sheets_of(fact: dict, spec: StarSpec, tabs: dict[str, Tab]) -> list[str]:
    """Sheets a fact is read from: the named ones that exist, in name order, else all."""
    named = set(fact.get("source_sheets") or []) | {s for c in spec.of(fact["table"]) if (s := source_sheet(c))}
    return sorted(n for n in named if n in tabs) or sorted(tabs)


def _source_rows(fact: dict, spec: StarSpec, tabs: dict[str, Tab], dims: dict[str, dict], known: dict[str, dict[str, str]]) -> DataFrame:
    """Rows behind one fact: its plain columns and, as structs ``d_<dimension>``, the dimension values."""
    parts = []
    used = sorted({t for t, _ in spec.foreign_keys(fact["table"]).values() if t in dims})
    for i, sheet in enumerate(_sheets_of(fact, spec, tabs)):
        tab = tabs[sheet]
        plain = [
            _value(tab, c).alias(c["name"]) for c in spec.of(fact["table"])
            if c["role"] != "pk" and c["name"] in known[fact["table"]] and spec.reference(c) is None
        ]
        groups = [
            F.struct(*[_value(tab, c).alias(c["name"]) for c in spec.of(d) if c["role"] != "pk" and c["name"] in known[d]]).alias(f"d_{d}")
            for d in used
        ]
        parts.append(tab.rows.select(F.lit(i).alias("_sheet"), F.col("pos").alias("_pos"), *plain, *groups))
    out = reduce(DataFrame.unionByName, parts)
    if isinstance(out.schema["_pos"].dataType, T.LongType):
        placed = out.withColumn("at", F.shiftleft(F.col("_sheet").cast("long"), AT_BITS) + F.col("_pos"))
        return durable(placed.drop("_sheet", "_pos"), "sources")
    return numbered(out, [F.asc("_sheet"), F.asc("_pos")], "at").drop("_sheet", "_pos")


def upsert_dimension(store: Store, dim: dict, spec: StarSpec, sources: list[DataFrame]) -> DataFrame:
    """Add the rows of ``sources`` whose natural key is new; known rows are reused, never changed.

    The rows lie in buckets of their typed key. Only buckets that get a new key are written, each with the rows it had,
    so a load that runs again, or shares keys with another, adds no row twice. Loads of one dimension must not run at
    the same time. Of several source rows with one key the first wins. The surrogate key is a 64-bit hash of table and
    natural key, so running again gives the same keys; keys that collide are hashed anew with another seed. Returns all
    stored rows.
    """
    table, known = dim["table"], store.columns(dim["table"])
    pk = next((c["name"] for c in spec.of(table) if c["role"] == "pk"), None)
    key = _natural_key(dim, spec, known)
    names = [c["name"] for c in spec.of(table) if c["role"] != "pk" and c["name"] in known]
    # the place of a row over all facts; the first row of a key is found by its number and its values are fetched after
    found = reduce(DataFrame.unionByName, [
        rows.select((F.shiftleft(F.lit(i).cast("long"), PLACE_BITS) + F.col("at")).alias("_at"), *[F.col(f"d_{table}")[n].alias(n) for n in names])
        for i, rows in enumerate(sources)
    ])
    keys = [F.col(k) for k in key]
    firsts = found.filter(_filled(keys)).groupBy(*key).agg(F.min("_at").alias("_at")).withColumn(BUCKET, _bucket(keys))
    stored = _read(store, table, bucketed=True)
    there = stored.select(F.col(BUCKET).alias("_b"), *[F.col(k).alias(f"_k_{k}") for k in key])
    # written first, so that the source rows are moved only where new keys are too many to broadcast, and never for none
    missing = durable(firsts.join(there, (F.col(BUCKET) == F.col("_b")) & _same(keys, [F.col(f"_k_{k}") for k in key]), "left_anti"), f"missing-{table}")
    if missing.isEmpty():
        return read_declared(store, table)
    fresh = found.join(missing.select("_at", BUCKET), "_at") if set(names) - set(key) else missing
    fresh = durable(fresh.select(_hash(keys, F.lit(table)).alias(pk), *names, BUCKET), f"new-{table}")
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most BUCKETS numbers
    for seed in range(1, 9):
        twice = fresh.groupBy(pk).count().filter(F.col("count") > 1).select(pk)
        taken = fresh.select(pk).join(stored.select(pk), pk, "left_semi")
        clash = durable(twice.unionByName(taken).distinct(), f"clash-{table}")
        if clash.isEmpty():
            break
        hit = fresh.join(clash.withColumn("_hit", F.lit(True)), pk, "left")
        again = F.when(F.col("_hit"), _hash(keys, F.lit(seed), F.lit(table))).otherwise(F.col(pk))
        fresh = durable(hit.withColumn(pk, again).drop("_hit").select(*fresh.columns), f"new-{table}")
    else:
        raise ValueError(f"surrogate keys of {table} are not unique")
    # what is read is also overwritten, so the old rows of the touched buckets are set aside first
    old = durable(stored.filter(F.col(BUCKET).isin(touched)), f"old-{table}")
    merged = old.unionByName(fresh, allowMissingColumns=True).select(*stored.columns)
    tasks = min(len(touched), int(store.spark.conf.get("spark.sql.shuffle.partitions")))
    merged.repartition(tasks, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(store.data_path(table))
    return read_declared(store, table)


def load(store: Store, spec: StarSpec, tabs: dict[str, Tab], upload_id: str) -> DataFrame:
    """Load dimensions, then facts with resolved keys; this upload's earlier fact rows are replaced.

    Only dimensions that some fact refers to are loaded. Returns :func:`load_report`.
    """
    dims = {d["table"]: d for d in spec.dimensions()}
    known = {t["table"]: store.columns(t["table"]) for t in spec.tables}
    sources = {f["table"]: _source_rows(f, spec, tabs, dims, known) for f in spec.facts()}
    lookups: dict[str, DataFrame] = {}
    for name, dim in dims.items():
        users = [sources[f["table"]] for f in spec.facts() if name in {t for t, _ in spec.foreign_keys(f["table"]).values()}]
        if users and any(c["role"] == "pk" for c in spec.of(name)):
            lookups[name] = upsert_dimension(store, dim, spec, users)
    for fact in spec.facts():
        table = fact["table"]
        rows = sources[table]
        for column, (dim, _) in spec.foreign_keys(table).items():
            if dim not in lookups:
                rows = rows.withColumn(column, F.lit(None).cast("bigint"))
                continue
            key = _natural_key(dims[dim], spec, known[dim])
            pk = next(c["name"] for c in spec.of(dim) if c["role"] == "pk")
            values = [F.col(f"d_{dim}")[k] for k in key]
            # every key of a source row is stored by now, under its hash; only keys that got another number, by a
            # collision or from other key columns, are looked up
            hashed = lookups[dim].select(F.col(pk).alias(column), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(key)])
            own = [F.col(f"_k{n}") for n in range(len(key))]
            odd = durable(hashed.filter(F.col(column) != _hash(own, F.lit(dim))).withColumn("_none", F.lit(0).cast("long")), f"odd-{dim}")
            # rows without a key have no partner; numbers of their own keep them apart
            apart = F.when(_filled(values), F.lit(0)).otherwise(F.pmod(F.xxhash64("at"), F.lit(4096)) + 1)
            given = rows.withColumns({"_apart": apart, **{f"_v{n}": v for n, v in enumerate(values)}})
            match = (F.col("_apart") == F.col("_none")) & _same([F.col(f"_v{n}") for n in range(len(key))], own)
            number = F.coalesce(F.col(column), F.when(_filled(values), _hash(values, F.lit(dim))))
            rows = given.join(odd, match, "left").select(*rows.columns, number.alias(column))
        pk = next((c["name"] for c in spec.of(table) if c["role"] == "pk"), None)
        if pk:
            # the row's place in its upload, so loading again gives equal keys
            rows = rows.withColumn(pk, F.xxhash64(F.lit(table), F.lit(upload_id), "at"))
        schema = table_schema(store, table)
        written = rows.select(
            *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != UPLOAD],
            F.lit(upload_id).alias(UPLOAD),
        )
        told = observed(written, {"rows": F.count(F.lit(1))}, lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(UPLOAD).parquet(store.data_path(table)))
        if not told["rows"]:
            # an empty upload writes no file, so old ones are removed here
            store._remove(f"{store.data_path(table)}/{UPLOAD}={upload_id}")
    return load_report(store, spec, upload_id)


def load_report(store: Store, spec: StarSpec, upload_id: str) -> DataFrame:
    """Rows per dimension (all), rows per fact (this upload) and its foreign keys left NULL."""
    out = None
    for t in [*spec.dimensions(), *spec.facts()]:
        rows, keys = read_declared(store, t["table"]), spec.foreign_keys(t["table"])
        if t["kind"] != "dimension":
            rows = rows.filter(F.col(UPLOAD) == upload_id)
        gaps = sum((F.count_if(F.col(k).isNull()) for k, (d, _) in keys.items() if d in {x["table"] for x in spec.dimensions()}), F.lit(0))
        one = rows.agg(F.count(F.lit(1)).alias("row_count"), gaps.cast("bigint").alias("fk_unresolved")).select(
            F.lit(t["kind"]).alias("kind"), F.lit(t["table"]).alias("table_name"), "row_count", "fk_unresolved"
        )
        out = one if out is None else out.unionByName(one)
    return out


def fk_orphans(store: Store, spec: StarSpec) -> DataFrame:
    """Non-NULL foreign keys without a parent, per key; all counts should be 0."""
    out = None
    for fact in spec.facts():
        rows = read_declared(store, fact["table"])
        for column, (dim, name) in spec.foreign_keys(fact["table"]).items():
            parents = read_declared(store, dim).select(F.col(name).alias("k"))
            used = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
            one = used.join(parents, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
                F.lit(fact["table"]).alias("table_name"), F.lit(column).alias("column_name"), "orphans"
            )
            out = one if out is None else out.unionByName(one)
    return out
