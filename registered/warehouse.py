"""Staging, mastering and fixed-star queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.text import is_blank
from ledgerloom.operators import master as M, star as W
from ledgerloom.plans.mastering import MasterState
from ledgerloom.session import durable, scratch_path
from ledgerloom.sources import runlog
from ledgerloom.sources.staging import Staging
from registered import oracle as O
from registered.inputs import derived_once, register
from registered.matching import CONFORMED, CONFORMED_COLUMNS, MESSY_MAP, conformed, lcs_sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


SALES_TYPES = dict(MESSY_MAP.values())
PRODUCT_TYPES = {"product_code": "string", "product": "string", "unit_price": "decimal", "unit_size": "string"}


def products(spark, d):
    register(spark, d)
    return spark.table("part").select(
        F.col("p_partkey").alias("pos"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("product_code"),
        F.when(F.col("p_partkey") % 5 == 1, F.concat("p_name", F.lit(" cocktail"))).otherwise(F.col("p_name")).alias("product"),
        F.col("p_retailprice").alias("unit_price"), F.col("p_size").cast("string").alias("unit_size"),
    )


_STAGING: dict[tuple[str, str], Staging] = {}


def warehouse(spark, d) -> Staging:
    """Three sales uploads and a product list, staged once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STAGING:
        st = Staging(spark, scratch_path(spark, "warehouse"))
        rows = conformed(spark, d)  # an upload's rows are picked before they are cleaned, so each is cleaned once
        for u in range(3):
            st.write("Sales", rows.filter(F.col("l_orderkey") % 3 == u), SALES_TYPES, f"u{u}")
        st.write("Products", products(spark, d), PRODUCT_TYPES, "u0")
        _STAGING[key] = st
    return _STAGING[key]


def harvested(spark, d):
    return warehouse(spark, d).harvest(W.HARVESTED)


# SQL: h has every staged row; pos orders tables, uploads and rows as staging does.
H = CONFORMED + """,
prod AS (SELECT p_partkey, lpad(p_partkey::varchar,8,'0') AS product_code, CASE WHEN p_partkey%5=1 THEN p_name||' cocktail' ELSE p_name END AS product,
  p_retailprice AS unit_price, p_size::varchar AS unit_size FROM part),
h0 AS (SELECT 'products' AS source_table, 'u0' AS upload_id, p_partkey AS k1, 0::bigint AS k2, 0::bigint AS k3, 0::bigint AS k4, 0.0::double AS k5, NULL::varchar AS customer_id, NULL::varchar AS customer,
  product_code, product, NULL::varchar AS vendor, NULL::varchar AS region, NULL::varchar AS channel, NULL::varchar AS order_date, NULL::double AS quantity, NULL::double AS amount, unit_price, unit_size FROM prod
 UNION ALL SELECT 'sales', 'u'||(l_orderkey%3), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, customer_id, customer, product_code, product, vendor, region, channel,
  order_date, quantity, amount, NULL, NULL FROM conformed),
h AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source_table, upload_id, k1,k2,k3,k4,k5) AS pos FROM h0)"""


@query("staging_upsert", O.with_(CONFORMED) + """SELECT 'u'||(l_orderkey%3) AS upload_id, count(*) AS row_count, round(sum(amount),2) AS amount,
 count(CASE WHEN l_orderkey%3=2 THEN 1 END) AS with_rep, count(order_date) AS dated FROM conformed GROUP BY 1""")
def staging_upsert(spark, d):
    st = Staging(spark, scratch_path(spark, "upsert"))
    rows = durable(conformed(spark, d), "conformed")
    part = [rows.filter(F.col("l_orderkey") % 3 == u) for u in range(3)]
    st.write("Sales", part[0], SALES_TYPES, "u0")
    st.write("Sales", part[1].limit(0).unionByName(part[2]), SALES_TYPES, "u1")  # a first, wrong u1
    st.write("Sales", part[1], SALES_TYPES, "u1")
    st.write("Sales", part[2].withColumn("sales_rep", F.col("vendor")), {**SALES_TYPES, "sales_rep": "string"}, "u2")
    return st.read("Sales").groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("amount"), 2).alias("amount"), F.count("sales_rep").alias("with_rep"),
        F.count("order_date").alias("dated"),
    )


@query("list_tables", O.with_(H) + "SELECT source_table AS table_name, count(*) AS row_count, count(DISTINCT upload_id)::int AS uploads, string_agg(DISTINCT upload_id,'|' ORDER BY upload_id) AS partitions FROM h GROUP BY 1")
def list_tables(spark, d):
    return warehouse(spark, d).list_tables().withColumn("partitions", F.array_join("partitions", "|"))


SALES_OUT = ", ".join(CONFORMED_COLUMNS)


@query("read_table", O.with_(H) + f"SELECT upload_id AS _partition, {SALES_OUT} FROM h WHERE source_table='sales'")
def read_table(spark, d):
    return warehouse(spark, d).read_table("Sales").select("_partition", *CONFORMED_COLUMNS)


@query("harvest_rows", O.with_(H) + "SELECT source_table, upload_id, customer_id, customer, product_code, product, vendor, unit_price, unit_size, count(*) AS n FROM h GROUP BY ALL")
def harvest_rows(spark, d):
    cols = ["source_table", "upload_id", "customer_id", "customer", "product_code", "product", "vendor", "unit_price", "unit_size"]
    return warehouse(spark, d).harvest(cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("delete_upload", O.with_(CONFORMED) + "SELECT 'u'||(l_orderkey%3) AS upload_id, count(*) AS row_count, 2::bigint AS partitions_dropped FROM conformed WHERE l_orderkey%3<>1 GROUP BY 1")
def delete_upload(spark, d):
    st = Staging(spark, scratch_path(spark, "delete"))
    rows = durable(conformed(spark, d), "conformed")
    for u in range(3):
        st.write("Sales", rows.filter(F.col("l_orderkey") % 3 == u), SALES_TYPES, f"u{u}")
    st.write("Products", products(spark, d), PRODUCT_TYPES, "u1")
    dropped = st.delete_upload("u1")
    return st.read("Sales").groupBy("upload_id").agg(F.count(F.lit(1)).alias("row_count")).withColumn("partitions_dropped", F.lit(dropped).cast("bigint"))


def run_entries(spark, d) -> str:
    """A run log with an entry per table and upload, and a failed run of each upload."""
    root = scratch_path(spark, "runs")
    counts = durable(warehouse(spark, d).harvest(["source_table"]).groupBy("source_table", "upload_id").agg(F.count(F.lit(1)).alias("n")), "runs")
    run_id, at = F.concat(F.lit("run-"), "upload_id"), F.lit("2024-01-02 03:04:05").cast("timestamp")
    done = counts.select(run_id.alias("run_id"), F.lit("SUCCESS").alias("status"), F.col("source_table").alias("job"), F.col("upload_id").alias("partition"), at.alias("started_at"))
    failed = counts.select(F.concat(run_id, F.lit("-failed")).alias("run_id"), F.lit("FAILURE").alias("status"), F.lit("ingest").alias("job"), F.col("upload_id").alias("partition"), at.alias("started_at")).distinct()
    done.unionByName(failed).write.mode("append").parquet(f"{root}/log/run_log")
    counts.select(run_id.alias("run_id"), F.col("source_table").alias("asset"), F.col("n").alias("row_count"), F.lit("").alias("details")).write.mode("append").parquet(f"{root}/log/materialized")
    checks = counts.select(F.concat(run_id, F.lit("-failed")).alias("run_id"), F.col("source_table").alias("asset"), F.lit("schema_drift").alias("check_name"), F.lit(False).alias("passed"), F.col("upload_id").alias("details"))
    checks.write.mode("append").parquet(f"{root}/log/check_log")
    return root


@query("run_detail", O.with_(H) + """SELECT 'materialized' AS part, 'run-'||upload_id AS run_id, source_table AS asset, count(*) AS row_count, NULL::boolean AS passed FROM h WHERE upload_id='u0' GROUP BY ALL
 UNION ALL SELECT DISTINCT 'check', 'run-'||upload_id||'-failed', source_table, NULL::bigint, false FROM h WHERE upload_id='u1'""")
def run_detail(spark, d):
    """What a finished run wrote, and the checks of a failed one."""
    root = run_entries(spark, d)
    wrote = runlog.run_detail(spark, root, "run-u0")["materializations"].select(F.lit("materialized").alias("part"), "run_id", "asset", "row_count", F.lit(None).cast("boolean").alias("passed"))
    checked = runlog.run_detail(spark, root, "run-u1-failed")["checks"].select(F.lit("check").alias("part"), "run_id", "asset", F.lit(None).cast("bigint").alias("row_count"), "passed")
    return wrote.unionByName(checked)


@query("harvest_clash", """SELECT 'list_a' AS source_table, lpad(p_partkey::varchar,8,'0') AS product_code, p_size||'mL' AS unit_size FROM part
 UNION ALL SELECT 'list_b', lpad(p_partkey::varchar,8,'0'), (p_size::double)::varchar FROM part""")
def harvest_clash(spark, d):
    """Two product lists whose sizes are text in one and numbers in the other."""
    st = Staging(spark, scratch_path(spark, "clash"))
    rows = products(spark, d)
    st.write("List A", rows.withColumn("unit_size", F.concat("unit_size", F.lit("mL"))), {"product_code": "string", "unit_size": "string"}, "u0")
    st.write("List B", rows, {"product_code": "string", "unit_size": "decimal"}, "u0")
    return st.harvest(["product_code", "unit_size"]).select("source_table", "product_code", "unit_size")


@query("run_history", O.with_(H) + """SELECT 'run-'||upload_id AS run_id, 'SUCCESS' AS status, source_table AS job, upload_id AS partition, count(*) AS row_count FROM h GROUP BY 1,2,3,4""")
def run_history(spark, d):
    root = run_entries(spark, d)
    runs = runlog.run_history(spark, root)
    made = spark.read.schema(runlog.MATERIALIZED).parquet(f"{root}/log/materialized").select("run_id", F.col("asset").alias("job"), "row_count")
    return runs.join(made, ["run_id", "job"]).select("run_id", "status", "job", "partition", "row_count")


# --- mastering ---------------------------------------------------------------------------------
IDN = {"customer": ("customer_id", "customer"), "product": ("product_code", "product"), "vendor": ("NULL::varchar", "vendor")}


def inst_sql(e: str) -> str:
    i, n = IDN[e]
    return f"""inst_{e} AS MATERIALIZED (SELECT *, CASE WHEN {O.filled('i')} THEN {O.norm('i')} ELSE 'name:'||{O.norm('n')} END AS key FROM
  (SELECT {i} AS i, {n} AS n, source_table, pos, region, channel, vendor, unit_size, unit_price FROM h) WHERE {O.filled('i')} OR {O.filled('n')})"""


def fold_sql(e: str) -> str:
    """map_<e>(key, root): where the walk over name-only buckets puts each of them."""
    x, y = "xa", "xb"
    return f"""bk_{e} AS (SELECT key, substr(key,6) AS nm, row_number() OVER (ORDER BY min(pos)) AS i FROM inst_{e} WHERE key LIKE 'name:%' GROUP BY 1),
tk_{e} AS (SELECT *, list_sort(list_distinct(string_split(nm,' '))) AS t FROM bk_{e} WHERE nm<>''),
pp_{e} AS (SELECT a.i AS lo, b.i AS hi, array_to_string(list_sort(list_intersect(a.t,b.t)),' ') AS s,
  array_to_string(list_filter(a.t, lambda v: NOT list_contains(b.t,v)),' ') AS xa, array_to_string(list_filter(b.t, lambda v: NOT list_contains(a.t,v)),' ') AS xb
  FROM tk_{e} a JOIN tk_{e} b ON a.i<b.i),
sc_{e} AS (SELECT lo, hi, length(s) AS si, length(xa) AS x, length(xb) AS y, CASE WHEN s='' THEN 0 ELSE 1 END AS gap,
  CASE WHEN xa='' OR xb='' OR (s<>'' AND (10*(1+length(xa))<=2*length(s)+1+length(xa) OR 10*(1+length(xb))<=2*length(s)+1+length(xb)))
    OR 10*levenshtein(xa,xb)>2*length(s)+length(xa)+length(xb)+CASE WHEN s='' THEN 0 ELSE 2 END THEN 0 ELSE {lcs_sql(x, y)} END AS c FROM pp_{e}),
ed_{e} AS (SELECT lo, hi FROM sc_{e} WHERE (si>0 AND (x=0 OR y=0)) OR (si>0 AND (10*(1+x)<=2*si+1+x OR 10*(1+y)<=2*si+1+y)) OR 10*(x+y-2*c)<=2*(si+gap)+x+y),
adj_{e} AS (SELECT hi AS j, list(lo) AS l FROM ed_{e} GROUP BY 1),
walk_{e} AS (SELECT 0::bigint AS i, []::bigint[] AS roots UNION ALL SELECT w.i+1, CASE WHEN list_has_any(w.roots, coalesce(a.l,[]::bigint[])) THEN w.roots ELSE list_append(w.roots, w.i+1) END
  FROM walk_{e} w LEFT JOIN adj_{e} a ON a.j=w.i+1 WHERE w.i<(SELECT count(*) FROM bk_{e})),
root_{e} AS (SELECT unnest(roots) AS r FROM walk_{e} WHERE i=(SELECT max(i) FROM walk_{e})),
map_{e} AS (SELECT b.key, b.i AS late, r.key AS root FROM (SELECT hi, min(lo) AS lo FROM ed_{e} WHERE lo IN (SELECT r FROM root_{e}) AND hi NOT IN (SELECT r FROM root_{e}) GROUP BY 1) m
  JOIN bk_{e} b ON b.i=m.hi JOIN bk_{e} r ON r.i=m.lo)"""


def golden_sql(e: str) -> str:
    """gold_<e>: golden records; needs h."""
    return f"""{inst_sql(e)},
{fold_sql(e)},
fi_{e} AS MATERIALIZED (SELECT t.*, coalesce(m.root,t.key) AS rk, coalesce(m.late,0) AS late FROM inst_{e} t LEFT JOIN map_{e} m ON m.key=t.key),
nc_{e} AS (SELECT rk, key, n, count(*) AS c, min(row(late,pos)) AS p FROM fi_{e} WHERE {O.filled('n')} GROUP BY 1,2,3),
cn_{e} AS (SELECT rk, arg_min(n, row(-c,-length(n),p)) AS name, string_agg(DISTINCT n,'|' ORDER BY n) AS variants FROM nc_{e} GROUP BY 1),
gold_{e} AS MATERIALIZED (SELECT '{e[:3]}_'||substr(sha1('{e}:'||rk),1,10) AS golden_id, rk AS key, coalesce(any_value(c.name),'') AS name,
  coalesce(string_agg(DISTINCT i,'|' ORDER BY i) FILTER (WHERE {O.filled('i')}),'') AS ids, coalesce(any_value(c.variants),'') AS name_variants,
  string_agg(DISTINCT source_table,',' ORDER BY source_table) AS sources, count(*) AS instance_count, min(pos) FILTER (WHERE late=0) AS first_pos,
  arg_min(region,row(late,pos)) FILTER (WHERE {O.filled('region')}) AS region, arg_min(channel,row(late,pos)) FILTER (WHERE {O.filled('channel')}) AS channel,
  arg_min(vendor,row(late,pos)) FILTER (WHERE {O.filled('vendor')}) AS vendor, arg_min(unit_size,row(late,pos)) FILTER (WHERE {O.filled('unit_size')}) AS unit_size,
  arg_min(unit_price,row(late,pos)) FILTER (WHERE unit_price IS NOT NULL) AS unit_price
  FROM fi_{e} f LEFT JOIN cn_{e} c USING (rk) GROUP BY rk)"""


_GOLDEN: dict[tuple[str, str, str], M.Golden] = {}


def golden(spark, d, entity) -> M.Golden:
    """Golden records of one entity, made once per application."""
    key = (spark.sparkContext.applicationId, d, entity)
    if key not in _GOLDEN:
        _GOLDEN[key] = M.golden(durable(M.instances(harvested(spark, d), M.SPECS[entity]), "instances"), entity)
    return _GOLDEN[key]


@query("master_buckets", O.with_(H, inst_sql("customer")) + f"""SELECT key, count(*) AS instance_count, coalesce(string_agg(DISTINCT i,'|' ORDER BY i) FILTER (WHERE {O.filled('i')}),'') AS ids,
 string_agg(DISTINCT source_table,'|' ORDER BY source_table) AS sources FROM inst_customer GROUP BY 1""")
def master_buckets(spark, d):
    b = M.buckets(M.instances(harvested(spark, d), M.SPECS["customer"]))
    return b.select("key", "instance_count", F.array_join("ids", "|").alias("ids"), F.array_join("sources", "|").alias("sources"))


@query("canonical_names", O.with_(H, inst_sql("product")) + f"""SELECT key, arg_min(n, row(-c,-length(n),p)) AS name FROM
 (SELECT key, n, count(*) AS c, min(pos) AS p FROM inst_product WHERE {O.filled('n')} GROUP BY 1,2) GROUP BY 1""")
def canonical_names(spark, d):
    return M.canonical_names(M.name_counts(M.instances(harvested(spark, d), M.SPECS["product"])))


@query("master_attributes", O.with_(H, inst_sql("customer")) + """SELECT key, arg_min(region,pos) FILTER (WHERE region IS NOT NULL) AS region, arg_min(channel,pos) FILTER (WHERE channel IS NOT NULL) AS channel FROM inst_customer GROUP BY 1""")
def master_attributes(spark, d):
    return M.first_attributes(M.instances(harvested(spark, d), M.SPECS["customer"])).select("key", "region", "channel")


SPELT = "CASE WHEN p_partkey%5=1 THEN p_name||' cocktail' WHEN p_partkey%7=1 THEN replace(p_name,'e','') ELSE p_name END"


def folded(spark, d, names: str):
    register(spark, d)
    rows = spark.sql(names).withColumn("source_table", F.lit("products"))
    counts = M.name_counts(M.instances(rows, M.SPECS["product"]))
    return M.fold_map(counts).select("key", "root")


@query("fuzzy_fold")  # DuckDB needs minutes for the pairs of all customers; a plain walk is compared in the tests
def fuzzy_fold(spark, d):
    return folded(spark, d, f"SELECT p_partkey AS pos, {SPELT} AS product FROM part UNION ALL SELECT 100000000+c_custkey, c_name FROM customer")


@query("fold_parts", O.with_(f"inst_x AS (SELECT p_partkey AS pos, 'name:'||{O.norm('n')} AS key FROM (SELECT *, {SPELT} AS n FROM part))", fold_sql("x")) + "SELECT key, root FROM map_x")
def fold_parts(spark, d):
    return folded(spark, d, f"SELECT p_partkey AS pos, {SPELT} AS product FROM part")


@query("golden_ids", O.with_(H, inst_sql("customer")) + "SELECT DISTINCT key, 'cus_'||substr(sha1('customer:'||key),1,10) AS golden_id FROM inst_customer")
def golden_ids(spark, d):
    keys = M.instances(harvested(spark, d), M.SPECS["customer"]).select("key").distinct()
    return keys.select("key", M.golden_id("customer", F.col("key")).alias("golden_id"))


def shown(g, *attrs):
    return g.select("golden_id", "name", F.array_join("ids", "|").alias("ids"), F.array_join("name_variants", "|").alias("name_variants"),
                    F.array_join("sources", ",").alias("sources"), *attrs, "instance_count")


GOLD_COLS = "golden_id, name, ids, name_variants, sources, {a}, instance_count"


@query("golden_customers", O.with_(H, golden_sql("customer")) + f"SELECT {GOLD_COLS.format(a='region, channel')} FROM gold_customer")
def golden_customers(spark, d):
    return shown(M.golden_records(harvested(spark, d), "customer").orderBy(*M.record_order()), "region", "channel")


@query("golden_products", O.with_(H, golden_sql("product")) + f"SELECT {GOLD_COLS.format(a='unit_size, cast(unit_price AS double) AS unit_price, vendor')} FROM gold_product")
def golden_products(spark, d):
    g = M.golden_records(harvested(spark, d), "product").withColumn("unit_price", F.col("unit_price").cast("double"))
    return shown(g.orderBy(*M.record_order()), "unit_size", "unit_price", "vendor")


@query("golden_vendors", O.with_(H, golden_sql("vendor")) + f"SELECT {GOLD_COLS.format(a='region')} FROM gold_vendor")
def golden_vendors(spark, d):
    return shown(M.golden_records(harvested(spark, d), "vendor").orderBy(*M.record_order()), "region")


def index_sql(e: str) -> str:
    return f"""ids_{e} AS (SELECT id, arg_max(golden_id, row(-instance_count,name,first_pos)) AS golden_id FROM (SELECT unnest(string_split(ids,'|')) AS id, * FROM gold_{e} WHERE ids<>'') GROUP BY 1),
nmx_{e} AS (SELECT nf, arg_max(golden_id, row(-instance_count,name,first_pos)) AS golden_id FROM (SELECT {O.norm('v')} AS nf, * FROM (SELECT unnest(string_split(name_variants,'|')) AS v, * FROM gold_{e} WHERE name_variants<>'')) GROUP BY 1)"""


@query("master_index", O.with_(H, golden_sql("product"), index_sql("product")) + "SELECT 'id' AS kind, id AS key, golden_id FROM ids_product UNION ALL SELECT 'name', nf, golden_id FROM nmx_product")
def master_index(spark, d):
    g = golden(spark, d, "product")
    return M.id_index(g).select(F.lit("id").alias("kind"), F.col("id").alias("key"), "golden_id").unionByName(
        M.name_index(g).select(F.lit("name").alias("kind"), F.col("name_form").alias("key"), "golden_id")
    )


def found_sql(e: str, i: str, n: str) -> str:
    return (f"coalesce((SELECT x.golden_id FROM ids_{e} x WHERE x.id={i} AND {O.filled(i)}), (SELECT x.golden_id FROM nmx_{e} x WHERE x.nf={O.norm(n)} AND {O.filled(n)}))")


@query("enrich_rows", O.with_(H, golden_sql("customer"), golden_sql("product"), index_sql("customer"), index_sql("product"),
       f"e AS (SELECT customer_id, customer, product_code, product, {found_sql('customer','customer_id','customer')} AS customer_golden_id, {found_sql('product','product_code','product')} AS product_golden_id FROM h)")
       + "SELECT *, count(*) AS n FROM e GROUP BY ALL")
def enrich_rows(spark, d):
    rows = harvested(spark, d)
    indexes = {e: M.Index.of(golden(spark, d, e)) for e in ("customer", "product")}
    out = M.enrich_rows(rows, indexes)
    cols = ["customer_id", "customer", "product_code", "product", "customer_golden_id", "product_golden_id"]
    return out.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


ALL_GOLD = [golden_sql("customer"), golden_sql("product"), golden_sql("vendor")]


@query("master_summary", O.with_(H, *ALL_GOLD) + "SELECT 'customer' AS entity, count(*) AS record_count FROM gold_customer UNION ALL SELECT 'product', count(*) FROM gold_product UNION ALL SELECT 'vendor', count(*) FROM gold_vendor")
def master_summary(spark, d):
    return M.master_summary({e: golden(spark, d, e).records for e in ("customer", "product", "vendor")})


# --- fixed star --------------------------------------------------------------------------------
@query("fact_sources", O.with_(H) + "SELECT source_table, count(*) AS row_count, round(sum(amount),2) AS amount FROM h WHERE source_table LIKE 'sales%' OR source_table IN (SELECT source_table FROM h WHERE amount IS NOT NULL) GROUP BY 1")
def fact_sources(spark, d):
    st = warehouse(spark, d)
    rows = st.harvest(["amount"]).filter(F.col("source_table").isin(st.fact_tables()))
    return rows.groupBy("source_table").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("amount"), 2).alias("amount"))


def dimension(spark, d, name):
    return W.dimensions({e: golden(spark, d, e) for e in M.SPECS})[name]


@query("dim_customer", O.with_(H, golden_sql("customer")) + "SELECT golden_id, name, region, channel, NULL::varchar AS sales_rep, NULL::varchar AS address_1, NULL::varchar AS city, NULL::varchar AS postal_code, sources FROM gold_customer")
def dim_customer(spark, d):
    return dimension(spark, d, "dim_customer")


@query("dim_product", O.with_(H, golden_sql("product")) + "SELECT golden_id, name, nullif(string_split(ids,'|')[1],'') AS product_code, unit_size, NULL::varchar AS bottle_size, vendor, sources FROM gold_product")
def dim_product(spark, d):
    return dimension(spark, d, "dim_product")


@query("dim_vendor", O.with_(H, golden_sql("vendor")) + "SELECT golden_id, name, sources FROM gold_vendor")
def dim_vendor(spark, d):
    return dimension(spark, d, "dim_vendor")


STAR = [H, *ALL_GOLD, index_sql("customer"), index_sql("product"), index_sql("vendor"),
        f"""fact AS MATERIALIZED (SELECT pos, k1, upload_id, source_table, order_date, quantity, amount, unit_price, channel, region, {found_sql('customer','customer_id','customer')} AS customer_golden_id,
  {found_sql('product','product_code','product')} AS product_golden_id, (SELECT x.golden_id FROM nmx_vendor x WHERE x.nf={O.norm('vendor')} AND {O.filled('vendor')}) AS vendor_golden_id
  FROM h WHERE source_table='sales')"""]


def star(spark, d) -> W.Star:
    g = {e: golden(spark, d, e) for e in ("customer", "product", "vendor")}
    return W.build_star(harvested(spark, d), warehouse(spark, d).fact_tables(), g)


FACT_COLUMNS = ["upload_id", "source_table", "order_date", "quantity", "amount", "unit_price", "channel", "region", "customer_golden_id", "product_golden_id", "vendor_golden_id"]


@query("fact_sales", O.with_(*STAR) + f"SELECT {', '.join(FACT_COLUMNS)} FROM fact")
def fact_sales(spark, d):
    return star(spark, d).fact_sales.select(*FACT_COLUMNS)


@query("rebuild_star", O.with_(*STAR) + "SELECT 'dim_customer' AS table_name, count(*) AS row_count FROM gold_customer UNION ALL SELECT 'dim_product', count(*) FROM gold_product UNION ALL SELECT 'dim_vendor', count(*) FROM gold_vendor UNION ALL SELECT 'fact_sales', count(*) FROM fact")
def rebuild_star(spark, d):
    root = scratch_path(spark, "star")
    W.publish(W.build_star(harvested(spark, d), warehouse(spark, d).fact_tables()), root)
    return W.read_star(spark, root).counts()


@query("fk_violations", O.with_(*STAR) + """SELECT 'customer_golden_id' AS foreign_key, 'dim_customer' AS "references", count(CASE WHEN k1%100=0 THEN 1 END) AS violations FROM fact UNION ALL SELECT 'product_golden_id', 'dim_product', 0 UNION ALL SELECT 'vendor_golden_id', 'dim_vendor', 0""")
def fk_violations(spark, d):
    s = star(spark, d)
    rows = durable(conformed(spark, d), "conformed").withColumns({"source_table": F.lit("sales"), "upload_id": F.lit("u0")})
    indexes = {e: M.Index.of(golden(spark, d, e)) for e in ("customer", "product", "vendor")}
    fact = W.fact_sales(rows, indexes, carried=["l_orderkey"])
    broken = fact.withColumn("customer_golden_id", F.when(F.col("l_orderkey") % 100 == 0, "cus_0000000000").otherwise(F.col("customer_golden_id")))
    return W.fk_violations(broken, s.tables())


@query("sales_view", O.with_(*STAR) + """SELECT row_number() OVER (ORDER BY f.pos) AS fact_id, f.order_date, f.quantity, f.amount, f.source_table, c.name AS customer, c.region, c.channel, p.name AS product, nullif(string_split(p.ids,'|')[1],'') AS product_code, v.name AS vendor
 FROM fact f LEFT JOIN gold_customer c ON c.golden_id=customer_golden_id LEFT JOIN gold_product p ON p.golden_id=product_golden_id LEFT JOIN gold_vendor v ON v.golden_id=vendor_golden_id""")
def sales_view(spark, d):
    return W.sales_view(star(spark, d)).drop("pos")


# --- mastering from states ---------------------------------------------------------------------
_STATE: dict[tuple[str, str], dict[str, M.Golden]] = {}


def mastered(spark, d) -> dict[str, M.Golden]:
    """Golden records after a rebuild that came before the last upload, and one after it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STATE:
        st = Staging(spark, scratch_path(spark, "mastered"))
        rows, state = durable(conformed(spark, d), "conformed"), MasterState(st)
        st.write("Products", products(spark, d), PRODUCT_TYPES, "u0")
        for u in (0, 1):
            st.write("Sales", rows.filter(F.col("l_orderkey") % 3 == u), SALES_TYPES, f"u{u}")
        state.catch_up()
        st.write("Sales", rows.filter(F.col("l_orderkey") % 3 == 2), SALES_TYPES, "u2")
        state.update("Sales", "u2")
        _STATE[key] = state.golden()
    return _STATE[key]


@query("master_state", O.with_(H, golden_sql("customer"), golden_sql("product")) + """SELECT 'customer' AS entity, golden_id, key, name, region, channel, NULL::varchar AS unit_size, instance_count FROM gold_customer
 UNION ALL SELECT 'product', golden_id, key, name, NULL, NULL, unit_size, instance_count FROM gold_product""")
def master_state(spark, d):
    c, p = (mastered(spark, d)[e].records for e in ("customer", "product"))
    none = F.lit(None).cast("string")
    return c.select(F.lit("customer").alias("entity"), "golden_id", "key", "name", "region", "channel", none.alias("unit_size"), "instance_count").unionByName(
        p.select(F.lit("product").alias("entity"), "golden_id", "key", "name", none.alias("region"), none.alias("channel"), "unit_size", "instance_count"))


@query("master_state_rows", O.with_(H, golden_sql("customer")) + """SELECT 'id' AS kind, golden_id, unnest(string_split(ids,'|')) AS value FROM gold_customer WHERE ids<>'' UNION ALL SELECT 'name', golden_id, unnest(string_split(name_variants,'|')) FROM gold_customer WHERE name_variants<>''
 UNION ALL SELECT 'source', golden_id, unnest(string_split(sources,',')) FROM gold_customer""")
def master_state_rows(spark, d):
    g = mastered(spark, d)["customer"]
    parts = [df.select(F.lit(k).alias("kind"), "golden_id", F.col(k).alias("value")) for k, df in (("id", g.ids), ("name", g.names), ("source", g.sources))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
