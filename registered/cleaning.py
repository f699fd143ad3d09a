"""Cleaning queries over the messy sales rows."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ledgerloom.functions import casts
from ledgerloom.functions.text import is_blank
from ledgerloom.operators import clean as C
from ledgerloom.operators.rules import INTERNAL
from registered import oracle as O
from registered.inputs import MESSY_TITLES, ORDER_KEY, messy_sales, register

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rule(rid: str, kind: str, title: str, enabled: bool = True, **spec) -> dict:
    return {"id": rid, "kind": kind, "title": title, "enabled": enabled, "spec": spec}


RULES = [
    rule("r1", "cast", "money", column="Net Sales", to="currency"),
    rule("r2", "cast", "iso", column="Date", to="date"),
    rule("r3", "cast", "text", column="SKU", to="string"),
    rule("r4", "combine_datetime", "stamp", date_col="Date", time_col="Time", target="event_timestamp"),
    rule("r5", "filter", "internal rows", column="Customer Name", op="regex_not", value=INTERNAL),
    rule("r6", "filter", "zero quantity", enabled=False, column="Qty", op="gt", value=0),
    rule("r7", "filter", "blank name", column="Customer Name", op="not_empty"),
    rule("r8", "dedupe", "duplicates", enabled=False),
]
SCHEMA = [
    {"name": "event_timestamp", "type": "timestamp", "role": "timestamp", "source": "Date", "time_source": "Time", "include": True},
    {"name": "customer_name", "type": "string", "role": "dimension", "source": "Customer Name", "include": True},
    {"name": "account_id", "type": "string", "role": "id", "source": "Account ID", "include": True},
    {"name": "sku", "type": "string", "role": "id", "source": "SKU", "include": True},
    {"name": "item", "type": "string", "role": "dimension", "source": "Item", "include": True},
    {"name": "qty", "type": "decimal", "role": "measure", "source": "Qty", "include": True},
    {"name": "net_sales", "type": "decimal", "role": "measure", "source": "Net Sales", "include": True},
    {"name": "supplier", "type": "string", "role": "dimension", "source": "Supplier", "include": True},
    {"name": "state", "type": "string", "role": "dimension", "source": "State", "include": True},
    {"name": "channel", "type": "string", "role": "dimension", "source": "Channel", "include": True},
    {"name": "currency", "type": "string", "role": "dimension", "source": "Currency", "include": False},
]
COLUMNS = [c["name"] for c in SCHEMA if c["include"]]


def messy_sheet(spark, d, name: str = "Sales") -> C.Sheet:
    """The messy rows as a sheet; the order keys travel with its rows."""
    return C.Sheet.of_table(messy_sales(spark, d), MESSY_TITLES, name=name, carried=ORDER_KEY)


def cleaned(spark, d, **kw) -> C.Cleaned:
    return C.clean(messy_sheet(spark, d), C.override_rules(RULES, **kw), SCHEMA)


def clean_sql() -> str:
    """CTEs messy, casted (all rows with cast values and the failing rule) and cleaned (kept rows)."""
    return O.messy() + f""",
casted AS MATERIALIZED (SELECT *, {O.iso_date('order_date_raw')}||'T'||{O.time_text('time_raw')} AS event_timestamp, {O.number('net_sales_raw')} AS net_sales,
   {O.iso_date('order_date_raw')} AS order_date_iso,
   CASE WHEN regexp_matches(customer_name_raw,'(?i){INTERNAL}') THEN 'internal rows' WHEN {O.blank('customer_name_raw')} THEN 'blank name' END AS reason
  FROM messy),
cleaned AS (SELECT pos, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, event_timestamp, customer_name_raw AS customer_name,
   account_id_raw AS account_id, sku_raw AS sku, item_raw AS item, qty_raw AS qty, net_sales, supplier_raw AS supplier,
   state_raw AS state, channel_raw AS channel FROM casted WHERE reason IS NULL)"""


KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("combine_datetime", O.with_(O.messy()) + f"""SELECT {KEY}, CASE WHEN l_orderkey%29=0 THEN NULL ELSE {O.iso_date('order_date_raw')} END||'T'||
 {O.time_text("CASE WHEN l_orderkey%31=0 THEN '' ELSE time_raw END")} AS event_timestamp FROM messy""")
def combine_datetime(spark, d):
    date = F.when(F.col("l_orderkey") % 29 != 0, F.col("order_date_raw"))
    time = F.when(F.col("l_orderkey") % 31 != 0, F.col("time_raw")).otherwise("")
    return messy_sales(spark, d).select(*ORDER_KEY, casts.date_and_time(date, time).alias("event_timestamp"))


@query("cast_string", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity=floor(l_quantity) THEN cast(cast(l_quantity AS bigint) AS varchar)
 ELSE cast(l_quantity AS varchar) END AS quantity, CASE WHEN l_extendedprice*1000=floor(l_extendedprice*1000) THEN cast(cast(l_extendedprice*1000 AS bigint) AS varchar)
 ELSE cast(l_extendedprice*1000 AS varchar) END AS price FROM lineitem""")
def cast_string(spark, d):
    register(spark, d)
    x = spark.table("lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        casts.cast_text(F.col("l_quantity"), T.DoubleType()).alias("quantity"),
        casts.cast_text(F.col("l_extendedprice") * 1000, T.DoubleType()).alias("price"),
    )


@query("cast_currency", O.with_(O.messy(), "v AS (SELECT pos, unnest([net_sales_raw, qty_raw||'%', '('||qty_raw||')', '-'||net_sales_raw, item_raw, '1e'||(l_linenumber), qty_raw||'d']) AS v FROM messy)")
       + f"SELECT v, {O.number('v')} AS number, count(*) AS n FROM v GROUP BY 1,2")
def cast_currency(spark, d):
    m = messy_sales(spark, d)
    qty = F.col("qty_raw")
    texts = F.array("net_sales_raw", F.concat(qty, F.lit("%")), F.concat(F.lit("("), qty, F.lit(")")), F.concat(F.lit("-"), "net_sales_raw"),
                    "item_raw", F.concat(F.lit("1e"), F.col("l_linenumber").cast("string")), F.concat(qty, F.lit("d")))
    return m.select(F.explode(texts).alias("v")).groupBy("v", casts.to_number(F.col("v")).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("cast_date", O.with_(O.messy(), "v AS (SELECT unnest([order_date_raw, ' '||item_raw||' ', '13/45/'||(100+l_linenumber), order_date_raw||'T10:00']) AS v FROM messy)")
       + f"SELECT v, {O.iso_date('v')} AS iso, count(*) AS n FROM v GROUP BY 1,2")
def cast_date(spark, d):
    m = messy_sales(spark, d)
    texts = F.array("order_date_raw", F.concat(F.lit(" "), "item_raw", F.lit(" ")),
                    F.concat(F.lit("13/45/"), (F.col("l_linenumber") + 100).cast("string")), F.concat("order_date_raw", F.lit("T10:00")))
    return m.select(F.explode(texts).alias("v")).groupBy("v", casts.iso_date(F.col("v")).alias("iso")).agg(F.count(F.lit(1)).alias("n"))


@query("time_of_day", O.with_(O.messy(), """f AS (SELECT round_even(((l_discount+l_quantity/7)-trunc(l_discount+l_quantity/7))*86400,0)::bigint AS s FROM lineitem)""")
       + f"""SELECT 'text' AS source, {O.time_text('time_raw')} AS clock, count(*) AS n FROM messy GROUP BY 1,2
 UNION ALL SELECT 'fraction', lpad((s//3600)::varchar,2,'0')||':'||lpad((s%3600//60)::varchar,2,'0')||':'||lpad((s%60)::varchar,2,'0'), count(*) FROM f GROUP BY 1,2
 UNION ALL SELECT 'timestamp', strftime(l_shipdate,'%H:%M:%S'), count(*) FROM lineitem GROUP BY 1,2""")
def time_of_day(spark, d):
    register(spark, d)
    li = spark.table("lineitem")

    def counted(df, source, clock):
        return df.groupBy(F.lit(source).alias("source"), clock.alias("clock")).agg(F.count(F.lit(1)).alias("n"))

    fraction = F.col("l_discount") + F.col("l_quantity") / 7
    return (
        counted(messy_sales(spark, d), "text", casts.time_of_day(F.col("time_raw")))
        .unionByName(counted(li, "fraction", casts.time_of_day(fraction, T.DoubleType())))
        .unionByName(counted(li, "timestamp", casts.time_of_day(F.col("l_shipdate"), T.TimestampType())))
    )


@query("filter_not_empty", O.with_(O.messy()) + f"SELECT {KEY}, customer_name_raw FROM messy WHERE NOT {O.blank('customer_name_raw')}")
def filter_not_empty(spark, d):
    return messy_sales(spark, d).filter(~is_blank(F.col("customer_name_raw"))).select(*ORDER_KEY, "customer_name_raw")


@query("filter_gt", O.with_(O.messy()) + f"SELECT {KEY}, qty_raw FROM messy WHERE coalesce({O.number('qty_raw')}>20,false)")
def filter_gt(spark, d):
    return messy_sales(spark, d).filter(C.greater_than(F.col("qty_raw"), 20.0)).select(*ORDER_KEY, "qty_raw")


@query("filter_regex_not", O.with_(O.messy()) + f"SELECT {KEY}, customer_name_raw FROM messy WHERE NOT coalesce(regexp_matches(customer_name_raw,'(?i){INTERNAL}'),false)")
def filter_regex_not(spark, d):
    return messy_sales(spark, d).filter(C.not_matching(F.col("customer_name_raw"), INTERNAL)).select(*ORDER_KEY, "customer_name_raw")


@query("filter_not_in", O.with_(O.messy()) + f"SELECT {KEY}, account_id_raw, channel_raw FROM messy WHERE coalesce(lower(account_id_raw),'none') NOT IN ('none','00000001') AND lower(channel_raw) NOT IN ('machinery')")
def filter_not_in(spark, d):
    kept = C.not_in(F.col("account_id_raw"), ["None", "00000001"]) & C.not_in(F.col("channel_raw"), ["MACHINERY"])
    return messy_sales(spark, d).filter(kept).select(*ORDER_KEY, "account_id_raw", "channel_raw")


@query("dropped_rows", O.with_(clean_sql()) + f"SELECT {KEY}, reason, order_date_iso AS sample FROM casted WHERE reason IS NOT NULL")
def dropped_rows(spark, d):
    return C.dropped_report(cleaned(spark, d)).select(*ORDER_KEY, "reason", "sample")


def doubled(spark, d) -> C.Sheet:
    """Messy rows with some of them repeated."""
    m = messy_sales(spark, d)
    again = m.filter(F.col("l_orderkey") % 50 == 0)
    both = m.withColumn("pos", F.col("pos") * 2).unionByName(again.withColumn("pos", F.col("pos") * 2 + 1))
    return C.Sheet.of_table(both, MESSY_TITLES, name="Sales", carried=ORDER_KEY)


DOUBLE = clean_sql() + """, both_ AS (SELECT *, 0 AS copy FROM casted UNION ALL SELECT *, 1 FROM casted WHERE l_orderkey%50=0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY order_date_iso,time_raw,customer_name_raw,account_id_raw,sku_raw,item_raw,qty_raw,net_sales,supplier_raw,
  state_raw,channel_raw,currency_raw,event_timestamp ORDER BY pos, copy) AS r FROM both_ WHERE reason IS NULL)"""


@query("dedupe_exact", O.with_(DOUBLE) + f"SELECT {KEY}, copy, customer_name_raw AS customer_name, sku_raw AS sku, net_sales FROM ranked WHERE r=1")
def dedupe_exact(spark, d):
    kept = C.clean(doubled(spark, d), C.override_rules(RULES, enabled={"r8": True}), SCHEMA).kept
    return kept.withColumn("copy", (F.col("pos") % 2).cast("int")).select(*ORDER_KEY, "copy", "customer_name", "sku", "net_sales")


@query("project_schema", O.with_(clean_sql()) + f"SELECT {KEY}, {', '.join(COLUMNS)} FROM cleaned")
def project_schema(spark, d):
    return cleaned(spark, d).kept.select(*ORDER_KEY, *COLUMNS)


DQ = " UNION ALL ".join(
    f"SELECT '{c['name']}' AS name, '{c['type']}' AS type, cast({c['name']} AS varchar) AS v FROM cleaned" for c in SCHEMA if c["include"]
)


@query("dq_stats", O.with_(clean_sql(), f"long AS ({DQ})") + f"""SELECT name, type, round(count(*) FILTER (WHERE {O.blank('v')})*100.0::double/count(*),1) AS null_pct,
 count(DISTINCT coalesce(v,'None')) AS "distinct" FROM long GROUP BY 1,2""")
def dq_stats(spark, d):
    return cleaned(spark, d).dq()


@query("clean_counts", O.with_(DOUBLE) + "SELECT (SELECT count(*) FROM both_) AS input_count, (SELECT count(*) FROM ranked WHERE r=1) AS kept_count, (SELECT count(*) FROM both_)-(SELECT count(*) FROM ranked WHERE r=1) AS dropped_count")
def clean_counts(spark, d):
    return C.clean(doubled(spark, d), C.override_rules(RULES, enabled={"r8": True}), SCHEMA).counts()


@query("rule_override", O.with_(clean_sql()) + f"""SELECT coalesce(reason, CASE WHEN coalesce({O.number('qty_raw')}>0,false) THEN NULL ELSE 'zero quantity' END,'kept') AS outcome, count(*) AS n
 FROM (SELECT * REPLACE (CASE WHEN reason='internal rows' AND NOT {O.blank('customer_name_raw')} THEN NULL ELSE reason END AS reason) FROM casted)
 GROUP BY 1""".replace("coalesce(reason, CASE", "coalesce(CASE").replace("END,'kept')", "END,reason,'kept')"))
def rule_override(spark, d):
    res = cleaned(spark, d, enabled={"r5": False, "r6": True})
    return res.marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


KEEP_ALL = " UNION ALL ".join(
    f"SELECT {h} AS header, '{n}' AS name, cast({x} AS varchar) AS value FROM casted"
    for n, h, x in [("event_timestamp", "NULL::varchar", "event_timestamp"), ("customer_name", "'Customer Name'", "customer_name_raw"),
                    ("account_id", "'Account ID'", "account_id_raw"), ("sku", "'SKU'", "sku_raw"), ("qty", "'Qty'", "qty_raw"),
                    ("channel", "'Channel'", "channel_raw")]
)


@query("clean_keep_all", O.with_(clean_sql(), f"long AS ({KEEP_ALL})") + "SELECT header, name, value, count(*) AS n FROM long GROUP BY 1,2,3")
def clean_keep_all(spark, d):
    kept = C.clean(messy_sheet(spark, d), C.keep_all_rows(RULES), SCHEMA).kept
    shown = [c for c in SCHEMA if c["name"] in ("event_timestamp", "customer_name", "account_id", "sku", "qty", "channel")]
    pairs = [
        F.struct(F.lit(None if c.get("time_source") else c["source"]).cast("string").alias("header"), F.lit(c["name"]).alias("name"),
                 F.col(c["name"]).alias("value"))
        for c in shown
    ]
    return kept.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.header", "p.name", "p.value").agg(F.count(F.lit(1)).alias("n"))


@query("coerce_types", O.with_(O.messy()) + f"""SELECT {KEY}, {O.number('net_sales_raw', '[,$]')} AS amount, {O.number("qty_raw||'%'", '[,$]')} AS share,
 cast(trunc({O.number("replace(net_sales_raw,'$','')", '[,]')}) AS bigint) AS whole, CASE WHEN {O.blank('customer_name_raw')} THEN NULL ELSE customer_name_raw END AS customer_name FROM messy""")
def coerce_types(spark, d):
    return messy_sales(spark, d).select(
        *ORDER_KEY,
        casts.coerce(F.col("net_sales_raw"), "currency").alias("amount"),
        casts.coerce(F.concat("qty_raw", F.lit("%")), "numeric").alias("share"),
        casts.coerce(F.translate("net_sales_raw", "$", ""), "integer").alias("whole"),
        casts.coerce(F.col("customer_name_raw"), "text").alias("customer_name"),
    )
