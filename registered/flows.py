"""Files, declared star, and whole-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import clean as C, declared as D, siblings as S
from ledgerloom.plans.automate import Automated, automate
from ledgerloom.plans.ingest import Ingested, cleaned_sheets, ingest
from ledgerloom.plans.signature import member_counts
from ledgerloom.plans.workbook import profile_payload, profile_workbook
from ledgerloom.session import durable, scratch_path
from ledgerloom.sources import delimited, export, uploads
from ledgerloom.sources.staging import Staging, Store
from registered import oracle as O
from registered.cleaning import RULES, SCHEMA, clean_sql, messy_sheet
from registered.inputs import MESSY_TITLES, ORDER_KEY, messy_sales, sheet_rows
from registered.matching import matches
from registered.sheets import RULES_SQL
from registered.warehouse import golden_sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


RAW = list(MESSY_TITLES)
RAW_LIST = ", ".join(RAW)


def exported(spark, d) -> str:
    """The messy rows as CSV files without a header."""
    path = scratch_path(spark, "csv")
    messy_sales(spark, d).select(*RAW).write.options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query("scan_delimited", O.with_(O.messy()) + f""", v AS (SELECT unnest(range({len(RAW)})) AS col_index, unnest([{', '.join(c for c in RAW)}]) AS v FROM messy),
typed AS (SELECT col_index, CASE WHEN v='' OR v IS NULL THEN NULL WHEN regexp_full_match(v,'-?[0-9]*\\.?[0-9]*') AND regexp_matches(v,'[0-9]')
   THEN CASE WHEN contains(v,'.') THEN 'float' ELSE 'int' END ELSE 'str' END AS kind, v FROM v)
SELECT col_index::int AS col_index, kind, CASE kind WHEN 'int' THEN cast(cast(v AS hugeint) AS varchar) ELSE v END AS text, count(*) AS n FROM typed WHERE kind IS NOT NULL GROUP BY 1,2,3""")
def scan_delimited(spark, d):
    rows = delimited.scan_delimited(spark, exported(spark, d))
    cells = rows.select(F.posexplode("cells").alias("col_index", "cell")).filter(F.col("cell").isNotNull())
    return cells.groupBy("col_index", "cell.kind", "cell.text").agg(F.count(F.lit(1)).alias("n"))


def odd_files(spark, d) -> str:
    """The parts as text files with commas and with tabs: quoted line breaks, doubled quotes, ragged rows."""
    root, parts = scratch_path(spark, "odd"), spark.read.parquet(f"{d}/part.parquet")
    for k, sep in enumerate((",", "\t")):
        name = F.concat(F.lit('"'), F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, F.lit('\n""new"" line' + sep)).otherwise(F.lit("")), F.lit('"'))
        more = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
        line = F.concat_ws(sep, F.col("p_partkey").cast("string"), name, F.col("p_size").cast("string"), more)
        parts.filter(F.col("p_partkey") % 2 == k).select(line).write.text(f"{root}/{k}")
    return root


@query("scan_odd_files", """WITH p AS (SELECT *, CASE WHEN p_partkey%4=0 THEN p_name||chr(10)||'"new" line'||CASE p_partkey%2 WHEN 0 THEN ',' ELSE chr(9) END ELSE p_name END AS name FROM part)
SELECT 0 AS col_index, 'int' AS kind, p_partkey::varchar AS text, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 1, 'str', name, count(*) FROM p GROUP BY ALL UNION ALL SELECT 2, 'int', p_size::varchar, count(*) FROM p GROUP BY ALL
UNION ALL SELECT 3, 'str', p_brand, count(*) FROM p WHERE p_partkey%3=0 GROUP BY ALL""")
def scan_odd_files(spark, d):
    rows = delimited.scan_delimited(spark, odd_files(spark, d))
    cells = rows.select(F.posexplode("cells").alias("col_index", "cell")).filter(F.col("cell").isNotNull())
    return cells.groupBy("col_index", "cell.kind", "cell.text").agg(F.count(F.lit(1)).alias("n"))


@query("export_csv", O.with_(O.messy()) + f"SELECT {', '.join(RAW)}, count(*) AS n FROM messy GROUP BY ALL")
def export_csv(spark, d):
    path = scratch_path(spark, "export")
    export.export_csv(messy_sales(spark, d).select(*RAW), path)
    back = spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{c} string" for c in RAW)).csv(path)
    return back.groupBy(*RAW).agg(F.count(F.lit(1)).alias("n"))


@query("export_json", O.with_(O.messy()) + f"SELECT {', '.join(RAW)}, count(*) AS n FROM messy GROUP BY ALL")
def export_json(spark, d):
    path = scratch_path(spark, "export")
    export.export_json(messy_sales(spark, d).select(*RAW), path)
    return spark.read.schema(", ".join(f"{c} string" for c in RAW)).json(path).groupBy(*RAW).agg(F.count(F.lit(1)).alias("n"))


@query("upload_manifest")
def upload_manifest(spark, d):
    return uploads.upload_manifest(spark, exported(spark, d), "part-*")


@query("profile_workbook", O.with_(RULES_SQL) + """SELECT k.sheet, k.kind, k.header_row, CASE WHEN k.kind='data' THEN (SELECT max(row_count) FROM prof p WHERE p.sheet=k.sheet) ELSE k.data_rows END AS row_count,
 (SELECT count(*) FROM prof p WHERE p.sheet=k.sheet) AS columns, (SELECT count(*) FROM rl WHERE rl.sheet=k.sheet) AS rules FROM kinds k""")
def workbook_query(spark, d):
    return profile_workbook(sheet_rows(spark, d)).summary().select("sheet", "kind", "header_row", "row_count", "columns", "rules")


@query("profile_payload")
def payload_query(spark, d):
    return profile_payload(profile_workbook(sheet_rows(spark, d)), matches(spark, d))


SALES_BODY = O.layout() + f""",
wide AS (SELECT row_no, max(text) FILTER (WHERE col_index=2) AS name, max(text) FILTER (WHERE col_index=3) AS account, max(text) FILTER (WHERE col_index=5) AS qty,
  max(text) FILTER (WHERE col_index=7) AS status FROM body WHERE sheet='Sales' GROUP BY 1)"""
INTERNAL_SQL = "(?i)(^|[^a-z])(employee|salesrep|sales ?rep|sample|comp|complimentary|donation|staff|internal|supplier|house ?account|admin)([^a-z]|$)"


@query("run_summary", O.with_(SALES_BODY) + f"""SELECT 'Sales' AS sheet, count(*) AS input_count, count(*) FILTER (WHERE NOT gone) AS kept_count, count(*) FILTER (WHERE gone) AS dropped_count
 FROM (SELECT coalesce(regexp_matches(name,'{INTERNAL_SQL}'),false) OR name IS NULL AS gone FROM wide)""")
def run_summary_query(spark, d):
    book = profile_workbook(sheet_rows(spark, d))
    told, done = cleaned_sheets(book, [(0, 0, "book.xlsx", "Sales", None)])
    return member_counts(told, done).select("sheet", "input_count", "kept_count", "dropped_count")


TABLES = [
    {"table": "sales", "file": "book.xlsx", "members": ["Sales"]},
    {"table": "products", "file": "book.xlsx", "members": ["Products", "Missing"]},
    {"table": "customers", "file": "book.xlsx", "members": ["Customers"]},
]


_INGESTED: dict[tuple[str, str], Ingested] = {}


def ingested(spark, d) -> Ingested:
    """The workbook ingested once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INGESTED:
        _INGESTED[key] = ingest(sheet_rows(spark, d), TABLES, Staging(spark, scratch_path(spark, "ingest")), "book_1")
    return _INGESTED[key]


# The cleaned sales rows and why others go; sheet rows that are blank are no rows.
GONE = "CASE WHEN o_orderkey%97=0 THEN 'Leave out rows without \"Customer Name\"' WHEN o_orderkey%53=0 OR o_orderkey%59=0 THEN 'Leave out internal rows by \"Customer Name\"' END"
DAY = "CASE WHEN o_orderkey%3=2 THEN '20'||substr(year(o_orderdate)::varchar,3,2) ELSE year(o_orderdate)::varchar END||strftime(o_orderdate,'-%m-%d')"
KEPT = f"so AS (SELECT *, {GONE} AS reason, {DAY} AS day FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderkey%211<>0)"
# Every staged row of the three tables, as mastering reads them.
BOOK_H = KEPT + """, h0 AS (SELECT 'customers' AS source_table, c_custkey AS k, lpad(c_custkey::varchar,8,'0') AS customer_id, c_name AS customer, NULL::varchar AS product_code, NULL::varchar AS product FROM customer
 UNION ALL SELECT 'products', p_partkey, NULL, NULL, lpad(p_partkey::varchar,8,'0'), p_name FROM part
 UNION ALL SELECT 'sales', o_orderkey, CASE WHEN o_custkey%11<>0 THEN lpad(c_custkey::varchar,8,'0') END, c_name, (900000000+o_orderkey)::varchar, NULL FROM so WHERE reason IS NULL),
h AS MATERIALIZED (SELECT *, NULL::varchar AS vendor, NULL::varchar AS region, NULL::varchar AS channel, NULL::varchar AS unit_size, NULL::double AS unit_price, row_number() OVER (ORDER BY source_table, k) AS pos FROM h0)"""


@query("ingest", O.with_(BOOK_H, golden_sql("customer"), golden_sql("product")) + """SELECT 'fact_sales' AS table_name, count(*) AS row_count FROM so WHERE reason IS NULL
 UNION ALL SELECT 'dim_product', count(*) FROM gold_product UNION ALL SELECT 'dim_customer', count(*) FROM gold_customer UNION ALL SELECT 'dim_vendor', 0""")  # barcodes of the sales sheet are product codes too
def ingest_query(spark, d):
    return ingested(spark, d).star.counts()


@query("ingest_members", O.with_(KEPT) + """SELECT 'sales' AS table_name, 'Sales' AS sheet, count(*) AS input_count, count(*) FILTER (WHERE reason IS NULL) AS kept_count, count(reason) AS dropped_count FROM so
 UNION ALL SELECT 'products', 'Products', count(*), count(*), 0 FROM part UNION ALL SELECT 'customers', 'Customers', count(*), count(*), 0 FROM customer""")
def ingest_members(spark, d):
    return ingested(spark, d).summary.members.drop("member_no")


@query("ingest_dropped", O.with_(KEPT) + "SELECT 'sales' AS table_name, 'Sales' AS sheet, o_orderkey+4 AS pos, reason, day AS sample FROM so WHERE reason IS NOT NULL")
def ingest_dropped(spark, d):
    return ingested(spark, d).summary.dropped


TABLE_INFO = [
    ("sales", "Sales", "order_date timestamp, customer string, customer_id string, order_total decimal, quantity decimal, product_code string, region string, rush string, delivered date, amount decimal", 7, "delivered, order_total, rush"),
    ("products", "Products", "product_code string, product string, brand string, unit_size decimal, unit_price decimal", 3, "brand, unit_size"),
    ("customers", "Customers", "customer_id string, customer string, channel string, region string, column_5 decimal, sales_rep string", 5, "column_5"),
]
TABLE_COUNT = {"sales": "(SELECT count(*) FROM so WHERE reason IS NULL)", "products": "(SELECT count(*) FROM part)", "customers": "(SELECT count(*) FROM customer)"}


@query("ingest_tables", O.with_(KEPT) + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {TABLE_COUNT[t]} AS row_count, '{cols}' AS columns, '{', '.join(c.split()[0] for c in cols.split(', '))}' AS added_columns, '{s}' AS sheets, "
    f"{known}::bigint AS known_entities, {len(new.split(', '))}::bigint AS new_entities, '{new}' AS new, 'extends registry' AS verdict, 0 AS baseline_uploads, 'none' AS added, 'none' AS removed, 'first upload' AS drift"
    for t, s, cols, known, new in TABLE_INFO))
def ingest_tables(spark, d):
    t = ingested(spark, d).summary.tables
    return t.withColumn("columns", F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ", "))


def dq_sql(table: str, sheet: str, rows: str, columns: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{sheet}' AS sheet, '{c}' AS name, '{t}' AS type, round(count(*) FILTER (WHERE ({e}) IS NULL)*100.0::double/count(*),1) AS null_pct, count(DISTINCT coalesce(({e})::varchar,'None')) AS \"distinct\" FROM {rows}"
        for c, (t, e) in columns.items())


@query("ingest_dq", O.with_(KEPT) + dq_sql("sales", "Sales", "so WHERE reason IS NULL", {
    "event_timestamp": ("timestamp", "day||lpad((o_orderkey%24)::varchar,2,'0')||lpad((o_custkey%60)::varchar,2,'0')"), "customer_name": ("string", "c_name"),
    "account_id": ("string", "CASE WHEN o_custkey%11<>0 THEN c_custkey END"), "order_total": ("decimal", "o_totalprice"), "qty": ("decimal", "o_orderkey%7"), "barcode": ("string", "o_orderkey"),
    "status": ("string", "o_orderstatus"), "rush": ("string", "o_orderpriority LIKE '1%'"), "delivered": ("date", "o_orderdate"), "net_sales": ("decimal", "floor(o_totalprice)*100+o_orderkey%100"),
}) + " UNION ALL " + dq_sql("products", "Products", "part", {"product_code": ("string", "p_partkey"), "product_description": ("string", "p_name"), "brand": ("string", "p_brand"), "unit_size": ("decimal", "p_size"), "default_selling_price": ("decimal", "p_retailprice")})
    + " UNION ALL " + dq_sql("customers", "Customers", "customer JOIN nation ON c_nationkey=n_nationkey", {"customer_code": ("string", "c_custkey"), "customer_name": ("string", "c_name"), "division": ("string", "c_mktsegment"), "state": ("string", "n_name"), "column_5": ("decimal", "c_acctbal"), "sales_rep": ("string", "c_nationkey")}))
def ingest_dq(spark, d):
    return ingested(spark, d).summary.dq


# --- declared star over the messy sales, loaded as two uploads ------------------------------------
SPEC_TABLES = [
    {"table": "dim_account", "kind": "dimension", "natural_key": ["account"]},
    {"table": "dim_item", "kind": "dimension", "natural_key": ["sku", "nothing"]},
    {"table": "dim_market", "kind": "dimension", "natural_key": []},
    {"table": "dim_unused", "kind": "dimension", "natural_key": ["name"]},
    {"table": "fact_orders", "kind": "fact", "natural_key": []},
]


def column(table, name, type_, role, source="", references=""):
    return {"table": table, "name": name, "type": type_, "role": role, "source": source, "references": references}


SPEC_COLUMNS = [
    column("dim_account", "account_key", "integer", "pk"), column("dim_account", "account", "text", "attribute", "Sales.Account ID"),
    column("dim_account", "name", "text", "attribute", "Sales.Customer Name"),
    column("dim_item", "item_key", "integer", "pk"), column("dim_item", "sku", "text", "attribute", "Sales.SKU"),
    column("dim_item", "item", "text", "attribute", "Sales.Item"),
    column("dim_market", "market_key", "integer", "pk"), column("dim_market", "state", "text", "attribute", "Sales.State"),
    column("dim_market", "channel", "text", "attribute", "Sales.Channel"),
    column("dim_unused", "unused_key", "integer", "pk"), column("dim_unused", "name", "text", "attribute", "Sales.Supplier"),
    column("fact_orders", "order_key", "integer", "pk"),
    column("fact_orders", "account_key", "integer", "fk", "", "dim_account.account_key"),
    column("fact_orders", "item_key", "integer", "fk", "", "dim_item.item_key"),
    column("fact_orders", "market_key", "integer", "fk", "", "dim_market.market_key"),
    column("fact_orders", "ordered_at", "timestamp", "attribute", "Sales.event_timestamp"),
    column("fact_orders", "qty", "integer", "measure", "Sales.Qty"),
    column("fact_orders", "net", "numeric", "measure", "Sales.Net Sales"),
]
SPEC = D.StarSpec(SPEC_TABLES, SPEC_COLUMNS)
WIDER = D.StarSpec(
    [*SPEC_TABLES, {"table": "dim_day", "kind": "dimension", "natural_key": ["day"]}],
    [*SPEC_COLUMNS, column("dim_item", "supplier", "text", "attribute", "Sales.Supplier"), column("fact_orders", "sold_by", "text", "attribute", "Sales.Supplier"),
     column("dim_day", "day_key", "integer", "pk"), column("dim_day", "day", "text", "attribute", "Sales.event_timestamp")],
)


def tabs_of(spark, d, half: int | None = None) -> dict[str, S.Tab]:
    sheet = messy_sheet(spark, d)
    kept = C.clean(sheet, C.keep_all_rows(RULES), SCHEMA).kept
    if half is not None:
        kept = kept.filter(F.col("l_orderkey") % 2 == half)
    return {"Sales": S.Tab.of("Sales", kept.drop(*ORDER_KEY), SCHEMA)}


_LOADED: dict[tuple[str, str], Store] = {}


def loaded(spark, d) -> Store:
    """Even orders loaded first, then odd ones; the even upload is loaded once more."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LOADED:
        store = Store(spark, scratch_path(spark, "declared"), "ai_")
        D.ensure_tables(store, SPEC)
        for half in (0, 1, 0):
            D.load(store, SPEC, tabs_of(spark, d, half), f"half{half}")
        _LOADED[key] = store
    return _LOADED[key]


DECLARED = clean_sql() + """,
src AS (SELECT *, row_number() OVER (ORDER BY l_orderkey%2, l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS i FROM casted),
da AS (SELECT account_id_raw AS account, arg_min(CASE WHEN trim(customer_name_raw)='' THEN NULL ELSE row(customer_name_raw) END, i) AS x, arg_min(row(nullif(trim(customer_name_raw),'')), i)[1] AS trimmed,
   arg_min(row(CASE WHEN trim(customer_name_raw)='' THEN NULL ELSE customer_name_raw END), i)[1] AS name FROM src WHERE account_id_raw IS NOT NULL GROUP BY 1),
di AS (SELECT sku_raw AS sku, arg_min(item_raw, i) AS item FROM src GROUP BY 1),
dm AS (SELECT DISTINCT state_raw AS state, channel_raw AS channel FROM src)"""


@query("upsert_dimension", O.with_(DECLARED) + "SELECT 'account' AS dim, account AS k, name AS v FROM da UNION ALL SELECT 'item', sku, item FROM di UNION ALL SELECT 'market', state, channel FROM dm")
def upsert_dimension(spark, d):
    st = loaded(spark, d)
    def part(t, k, v):
        return D.read_declared(st, t).select(F.lit(t[4:]).alias("dim"), F.col(k).alias("k"), F.col(v).alias("v"))

    return part("dim_account", "account", "name").unionByName(part("dim_item", "sku", "item")).unionByName(part("dim_market", "state", "channel"))


@query("load_facts", O.with_(DECLARED) + """SELECT 'half'||(l_orderkey%2) AS upload_id, account_id_raw AS account, sku_raw AS sku, state_raw AS state, event_timestamp AS ordered_at, cast(qty_raw AS bigint) AS qty, net_sales AS net FROM src""")
def load_facts(spark, d):
    st = loaded(spark, d)
    f = D.read_declared(st, "fact_orders")
    a, i, m = (D.read_declared(st, t) for t in ("dim_account", "dim_item", "dim_market"))
    joined = f.join(a, "account_key", "left").join(i, "item_key", "left").join(m, "market_key", "left")
    return joined.select(F.col("_upload_id").alias("upload_id"), "account", "sku", "state", "ordered_at", "qty", "net")


@query("fact_ids", O.with_(DECLARED) + "SELECT count(*) AS facts, count(*) AS ids, true AS repeated FROM src")
def fact_ids(spark, d):
    """Ids of all facts after three loads, and whether loading an upload again gives the same ones."""
    st = loaded(spark, d)
    facts = D.read_declared(st, "fact_orders").select("order_key", "_upload_id")
    before = durable(facts, "fact-ids")
    D.load(st, SPEC, tabs_of(spark, d, 0), "half0")
    gone = before.join(D.read_declared(st, "fact_orders").select("order_key"), "order_key", "left_anti")
    return before.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("order_key").alias("ids")).withColumn("repeated", F.lit(gone.isEmpty()))


@query("load_report", O.with_(DECLARED) + """SELECT 'dimension' AS kind, 'dim_account' AS table_name, (SELECT count(*) FROM da) AS row_count, 0::bigint AS fk_unresolved UNION ALL SELECT 'dimension','dim_item',(SELECT count(*) FROM di),0
 UNION ALL SELECT 'dimension','dim_market',(SELECT count(*) FROM dm),0 UNION ALL SELECT 'dimension','dim_unused',0,0 UNION ALL SELECT 'fact','fact_orders',count(*),count(*) FILTER (WHERE account_id_raw IS NULL) FROM src WHERE l_orderkey%2=1""")
def load_report(spark, d):
    return D.load_report(loaded(spark, d), SPEC, "half1")


@query("fk_orphans", O.with_(DECLARED) + """SELECT 'fact_orders' AS table_name, unnest(['account_key','item_key','market_key']) AS column_name, unnest([0::bigint, (SELECT count(*) FROM src WHERE sku_raw LIKE '%7'), 0]) AS orphans""")
def fk_orphans(spark, d):
    """A copy of the loaded star whose item dimension lost the codes that end in 7."""
    st = loaded(spark, d)
    lame = Store(spark, scratch_path(spark, "orphans"), "ai_")
    D.ensure_tables(lame, SPEC)
    for t in ("dim_account", "dim_item", "dim_market", "fact_orders"):
        rows = D.read_declared(st, t)
        rows = rows.filter(~F.col("sku").endswith("7")) if t == "dim_item" else rows
        rows.write.mode("append").parquet(lame.data_path(t))
    return D.fk_orphans(lame, SPEC)


@query("star_diff", O.with_(DECLARED) + """SELECT action, object, rows_there FROM (VALUES ('created','dim_day',0),('reused','dim_account',(SELECT count(*) FROM da)),('reused','dim_item',(SELECT count(*) FROM di)),
 ('reused','dim_market',(SELECT count(*) FROM dm)),('reused','dim_unused',0),('reused','fact_orders',(SELECT count(*) FROM src)),('altered','dim_item.supplier',(SELECT count(*) FROM di)),
 ('altered','fact_orders.sold_by',(SELECT count(*) FROM src))) t(action,object,rows_there)""")
def star_diff(spark, d):
    st = loaded(spark, d)
    counts = None
    for t in st.tables():
        one = D.read_declared(st, t).agg(F.count(F.lit(1)).alias("rows_there")).select(F.lit(t).alias("t"), "rows_there")
        counts = one if counts is None else counts.unionByName(one)
    diff = D.star_diff(st, WIDER).withColumn("t", F.split("object", r"\.").getItem(0))
    return diff.join(counts, "t", "left").select("action", "object", F.coalesce("rows_there", F.lit(0)).alias("rows_there"))


BOOK_SPEC = D.StarSpec(
    [{"table": "dim_client", "kind": "dimension", "natural_key": ["client"]}, {"table": "fact_lines", "kind": "fact", "natural_key": []}],
    [column("dim_client", "client_key", "integer", "pk"), column("dim_client", "client", "text", "attribute", "Sales.Customer Name"),
     column("fact_lines", "client_key", "integer", "fk", "", "dim_client.client_key"), column("fact_lines", "status", "text", "degenerate", "Sales.Status"),
     column("fact_lines", "qty", "integer", "measure", "Sales.Qty")],
)


MONTHS = 12


def monthly(spark, d):
    """The sales sheet as one tab for each month, all with the same titles."""
    rows = sheet_rows(spark, d).filter(F.col("sheet") == "Sales")
    top = rows.filter(F.col("row_no") < 4).withColumn("tab", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
    rest = rows.filter(F.col("row_no") >= 4).withColumns({"tab": (F.col("row_no") % MONTHS).cast("int"), "row_no": F.floor((F.col("row_no") - 4) / MONTHS) + 4})
    name = F.concat(F.lit("Sales "), F.lpad(F.col("tab").cast("string"), 2, "0"))
    return top.unionByName(rest).select("file", name.alias("sheet"), "row_no", "cells")


def month_spec(sheet: str) -> D.StarSpec:
    return D.StarSpec(
        [{"table": "dim_client", "kind": "dimension", "natural_key": ["client"]}, {"table": "fact_lines", "kind": "fact", "natural_key": []}],
        [column("dim_client", "client_key", "integer", "pk"), column("dim_client", "client", "text", "attribute", f"{sheet}.Customer Name"),
         column("fact_lines", "client_key", "integer", "fk", "", "dim_client.client_key"), column("fact_lines", "status", "text", "degenerate", f"{sheet}.Status"),
         column("fact_lines", "qty", "integer", "measure", f"{sheet}.Qty")],
    )


_AUTOMATED: dict[tuple[str, str], Automated] = {}


def automated(spark, d) -> Automated:
    """Twelve monthly tabs loaded into a declared star, once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _AUTOMATED:
        store = Store(spark, scratch_path(spark, "automate"), "ai_")
        _AUTOMATED[key] = automate(monthly(spark, d), "book.xlsx", month_spec("Sales 03"), store, "book_1")
    return _AUTOMATED[key]


@query("automate", O.with_(SALES_BODY) + "SELECT 'dimension' AS kind, 'dim_client' AS table_name, count(DISTINCT name) AS row_count, 0::bigint AS fk_unresolved FROM wide UNION ALL SELECT 'fact','fact_lines', count(*), count(*) FILTER (WHERE name IS NULL) FROM wide")
def automate_query(spark, d):
    store = Store(spark, scratch_path(spark, "automate"), "ai_")
    return automate(sheet_rows(spark, d), "book.xlsx", BOOK_SPEC, store, "book_1").report


@query("automate_months", O.with_(SALES_BODY) + "SELECT 'dimension' AS kind, 'dim_client' AS table_name, count(DISTINCT name) AS row_count, 0::bigint AS fk_unresolved FROM wide UNION ALL SELECT 'fact','fact_lines', count(*), count(*) FILTER (WHERE name IS NULL) FROM wide")
def automate_months(spark, d):
    return automated(spark, d).report


@query("automate_folds", O.with_(SALES_BODY) + f"""SELECT 'Sales 03' AS unioned_into, (SELECT string_agg('Sales '||lpad(k::varchar,2,'0'), ', ' ORDER BY k) FROM range({MONTHS}) r(k) WHERE k<>3) AS folded_tabs,
 count(*) FILTER (WHERE row_no%{MONTHS}<>3) AS rows_added FROM wide""")
def automate_folds(spark, d):
    return automated(spark, d).folds


@query("automate_tables", """SELECT 'after' AS phase, 'dim_client' AS table_name, 'client_key bigint, client text' AS columns, 'client_key' AS primary_key, '' AS foreign_keys, true AS new
 UNION ALL SELECT 'after', 'fact_lines', 'client_key bigint, status text, qty integer', '', 'client_key -> dim_client.client_key', true""")
def automate_tables(spark, d):
    shown = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ", ")
    return automated(spark, d).tables.select("phase", "table_name", shown.alias("columns"), F.array_join("primary_key", ", ").alias("primary_key"), F.array_join("foreign_keys", ", ").alias("foreign_keys"), "new")


@query("automate_checks", """SELECT 'created' AS what, 'dim_client' AS object, NULL::bigint AS orphans UNION ALL SELECT 'created','fact_lines',NULL UNION ALL SELECT 'foreign_key','fact_lines.client_key -> dim_client.client_key',NULL
 UNION ALL SELECT 'orphans','fact_lines.client_key',0""")
def automate_checks(spark, d):
    done = automated(spark, d)
    lost = done.orphans.select(F.lit("orphans").alias("what"), F.concat_ws(".", "table_name", "column_name").alias("object"), F.col("orphans").cast("bigint").alias("orphans"))
    return done.diff.select(F.col("action").alias("what"), "object", F.lit(None).cast("bigint").alias("orphans")).unionByName(lost)
