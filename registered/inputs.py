"""Messy inputs derived from the supplied tables, in Spark and in DuckDB SQL.

Both engines get the same SELECT text; ``{S}`` is the string type and ``{G}`` the thousands pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.text import kind_of, text_of
from ledgerloom.operators.numbering import numbered, starts
from ledgerloom.session import durable

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def spark_sql(text: str) -> str:
    return text.replace("{S}", "string").replace("{G}", "$1,$2")


def duck_sql(text: str) -> str:
    return text.replace("{S}", "varchar").replace("{G}", r"\1,\2")


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(spark_sql(text))


_DERIVED: dict[tuple[str, str, str], DataFrame] = {}


def derived_once(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A derived input is written once per application and read back by every query that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DERIVED:
        _DERIVED[key] = durable(build(), name)
    return _DERIVED[key]


ORDER_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

DATE_RAW = """CASE {k} % 3
   WHEN 0 THEN concat(cast(year(o_orderdate) AS {S}),'-',lpad(cast(month(o_orderdate) AS {S}),2,'0'),'-',
                      lpad(cast(day(o_orderdate) AS {S}),2,'0'))
   WHEN 1 THEN concat(cast(month(o_orderdate) AS {S}),'/',cast(day(o_orderdate) AS {S}),'/',cast(year(o_orderdate) AS {S}))
   ELSE concat(cast(month(o_orderdate) AS {S}),'/',cast(day(o_orderdate) AS {S}),'/',
               substring(cast(year(o_orderdate) AS {S}),3,2)) END"""


def money(amount: str, cents: str) -> str:
    return (
        "concat('$', regexp_replace(cast(cast(floor(" + amount + ") AS bigint) AS {S}),'([0-9]+)([0-9]{3})$','{G}'),"
        "'.',lpad(cast(" + cents + " % 100 AS {S}),2,'0'))"
    )


MESSY_COLUMNS = (
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 month(o_orderdate) AS month_no, """
    + DATE_RAW.replace("{k}", "l_orderkey")
    + """ AS order_date_raw,
 concat(cast(l_orderkey % 24 AS {S}),':',lpad(cast(l_partkey % 60 AS {S}),2,'0')) AS time_raw,
 CASE WHEN o_orderkey % 97 = 0 THEN '  '
      WHEN o_orderkey % 53 = 0 THEN concat('Employee_',c_name)
      WHEN l_linenumber % 3 = 1 THEN upper(c_name)
      WHEN l_linenumber % 3 = 2 THEN replace(c_name,'#',' ') ELSE c_name END AS customer_name_raw,
 CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE lpad(cast(c_custkey AS {S}),8,'0') END AS account_id_raw,
 lpad(cast(p_partkey AS {S}),8,'0') AS sku_raw,
 p_name AS item_raw,
 CASE WHEN l_orderkey % 41 = 0 THEN '0' ELSE cast(cast(floor(l_quantity) AS bigint) AS {S}) END AS qty_raw,
 """
    + money("l_extendedprice", "l_orderkey")
    + """ AS net_sales_raw,
 s_name AS supplier_raw, n_name AS state_raw, c_mktsegment AS channel_raw, 'USD' AS currency_raw
"""
)
MESSY_SALES = MESSY_COLUMNS + """FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey
JOIN nation ON c_nationkey=n_nationkey"""
# The same rows in Spark. Line items meet the short names of parts while they are narrow, are numbered among those of their
# order where they meet it, and meet suppliers last; an order's rows start behind those of all smaller orders. Rows of a line item
# that a repeated key multiplies get numbers of their own.
NUMBERED_SALES = MESSY_COLUMNS.replace("SELECT ", """SELECT (({place})*{supplier}+s_copy)*{order}+o_copy AS pos, """, 1) + """FROM {lines}
JOIN (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderkey)-1 AS o_copy FROM
  (SELECT o_orderkey, o_custkey, o_orderdate, c_custkey, c_name, c_mktsegment, n_name
   FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE o_orderkey IS NOT NULL)) ON l_orderkey=o_orderkey
JOIN (SELECT s_suppkey, s_name, row_number() OVER (PARTITION BY s_suppkey ORDER BY s_suppkey)-1 AS s_copy FROM supplier WHERE s_suppkey IS NOT NULL) ON l_suppkey=s_suppkey"""
PART_LINES = """messy_lines JOIN (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_partkey ORDER BY p_partkey)-1 AS p_copy FROM part WHERE p_partkey IS NOT NULL) ON l_partkey=p_partkey"""
# Where the rows of a line item lie: behind smaller orders and earlier rows of its own, or by its number among all line items.
PLACED = ("l_start*{part}+l_place", """(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,p_copy)-1 AS l_place FROM """
          + PART_LINES + """) JOIN messy_starts ON l_orderkey=s_orderkey""")
NUMBERED = ("(l_line-1)*{part}+p_copy", PART_LINES)
#: An order of more line items than this is not numbered in one task.
LARGE_ORDER = 1 << 20
MESSY_DIMENSIONS = {"supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey"}

# Sheet titles of the messy columns.
MESSY_TITLES = {
    "order_date_raw": "Date", "time_raw": "Time", "customer_name_raw": "Customer Name", "account_id_raw": "Account ID",
    "sku_raw": "SKU", "item_raw": "Item", "qty_raw": "Qty", "net_sales_raw": "Net Sales", "supplier_raw": "Supplier",
    "state_raw": "State", "channel_raw": "Channel", "currency_raw": "Currency",
}


def most_copies(spark: SparkSession, keys: dict[str, str]) -> dict[str, int]:
    """How many rows the most frequent key of each table has, at least 1."""
    out = None
    for table, key in keys.items():
        counts = spark.table(table).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        one = counts.agg(F.max("n").alias("n")).select(F.lit(table).alias("t"), F.coalesce("n", F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return {r["t"]: r["n"] for r in out.collect()}


def messy_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dirty row per line item; ``pos`` numbers the rows in the order of ``ORDER_KEY``, with gaps where a row meets nothing.

    A number keeps aggregates over ``pos`` in the hash aggregate; a struct would force sorting. Only the numbers of line items
    in each order are sorted by range; the rows themselves are numbered where they meet their orders.
    """

    def build():
        register(spark, sf_dir)
        lines = spark.table("lineitem").select(*ORDER_KEY, "l_quantity").dropna(subset=["l_orderkey", "l_partkey", "l_suppkey"])
        counts = durable(lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("l_rows")), "order-lines")
        if (counts.agg(F.max("l_rows")).first()[0] or 0) > LARGE_ORDER:
            place, joined = NUMBERED
            lines = numbered(lines, [F.asc(c) for c in ORDER_KEY], "l_line")
        else:
            place, joined = PLACED
            starts(counts, "l_orderkey", "l_rows", "l_start").withColumnRenamed("l_orderkey", "s_orderkey").createOrReplaceTempView("messy_starts")
        lines.createOrReplaceTempView("messy_lines")
        most = most_copies(spark, MESSY_DIMENSIONS)
        times = {"supplier": most["supplier"], "part": most["part"], "order": most["orders"] * most["customer"] * most["nation"]}
        text = NUMBERED_SALES.replace("{place}", place).replace("{lines}", joined)
        for name, n in times.items():
            text = text.replace("{" + name + "}", f"{n}L")
        return spark.sql(spark_sql(text))

    return derived_once("messy-sales", spark, sf_dir, build)


# ---------------------------------------------------------------------------------------------
# A workbook with one sheet per table. ``key`` is dense from 0, so it numbers the data rows.
# columns: (title, SQL expression). preamble: rows above the header.
_UNLESS_BLANK = "CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE {e} END"


def _sales(e: str) -> str:
    return _UNLESS_BLANK.replace("{e}", e)


SHEETS = [
    {
        "sheet": "Sales", "key": "o_orderkey", "from": "orders JOIN customer ON o_custkey = c_custkey",
        "preamble": [["Sales report"], [], ["Region", "All"]], "trailing": 3,
        "columns": [
            ("Date", _sales(DATE_RAW.replace("{k}", "o_orderkey"))),
            ("Time", _sales("concat(cast(o_orderkey % 24 AS {S}),':',lpad(cast(o_custkey % 60 AS {S}),2,'0'))")),
            ("Customer Name", _sales("CASE WHEN o_orderkey % 97 = 0 THEN '  ' WHEN o_orderkey % 53 = 0 THEN concat('Employee_',c_name) "
                                     "WHEN o_orderkey % 59 = 0 THEN concat('STAFF ',c_name) ELSE c_name END")),
            ("Account ID", _sales("CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE lpad(cast(c_custkey AS {S}),8,'0') END")),
            ("Order Total", _sales("o_totalprice")),
            ("Qty", _sales("cast(o_orderkey % 7 AS bigint)")),
            ("Barcode", _sales("cast(900000000 + o_orderkey AS bigint)")),
            ("Status", _sales("o_orderstatus")),
            ("Rush", _sales("CASE WHEN o_orderpriority LIKE '1%' THEN 'Yes' ELSE 'No' END")),
            ("Currency", _sales("'USD'")),
            ("Notes", "cast(NULL AS {S})"),
            ("Discount", _sales("cast(0 AS bigint)")),
            ("Delivered", _sales("o_orderdate")),
            ("Net Sales", _sales(money("o_totalprice", "o_orderkey"))),
        ],
    },
    {
        "sheet": "Products", "key": "p_partkey", "from": "part", "preamble": [], "trailing": 0,
        "columns": [
            ("Product Code", "lpad(cast(p_partkey AS {S}),8,'0')"), ("Product Description", "p_name"), ("Brand", "p_brand"),
            ("Unit Size", "p_size"), ("Default Selling Price", "p_retailprice"),
        ],
    },
    {
        "sheet": "Customers", "key": "c_custkey", "from": "customer JOIN nation ON c_nationkey = n_nationkey",
        "preamble": [["Customer master"]], "trailing": 1,
        "columns": [
            ("Customer Code", "lpad(cast(c_custkey AS {S}),8,'0')"), ("Customer Name", "c_name"), ("Division", "c_mktsegment"),
            ("State", "n_name"), (" ", "c_acctbal"), ("Sales Rep", "concat('Rep ',cast(c_nationkey AS {S}))"),
        ],
    },
    {
        "sheet": "Vendors", "key": "s_suppkey", "from": "supplier JOIN nation ON s_nationkey = n_nationkey",
        "preamble": [], "trailing": 2,
        "columns": [
            ("Supplier Name", "s_name"), ("Region", "n_name"), ("Balance", money("abs(s_acctbal)", "s_suppkey")),
            ("Terms", "'NET30'"), ("Supplier Key", "s_suppkey"),
        ],
    },
    {
        "sheet": "Cover", "key": "r_regionkey", "from": "region", "preamble": [], "trailing": 0,
        "columns": [("Region", "r_name"), ("Key", "r_regionkey")],
    },
    {
        "sheet": "Notes", "key": "n_nationkey", "from": "nation", "preamble": [], "trailing": 0,
        "columns": [("Nation", "n_name"), ("Key", "n_nationkey"), ("Region Key", "n_regionkey")],
    },
]
BOOK = "book.xlsx"
# Cell kinds of the typed expressions above, needed by the SQL side only.
SQL_KINDS = {
    "o_totalprice": "float", "p_retailprice": "float", "c_acctbal": "float", "o_orderdate": "datetime", "p_size": "int",
    "s_suppkey": "int", "r_regionkey": "int", "n_nationkey": "int", "n_regionkey": "int",
}


def _typed_select(sheet: dict) -> str:
    shift = len(sheet["preamble"]) + 1
    body = ", ".join(f"{e} AS c{i}" for i, (_, e) in enumerate(sheet["columns"]))
    return f"SELECT cast({sheet['key']} + {shift} AS bigint) AS row_no, {body} FROM {sheet['from']}"


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbook as ``file, sheet, row_no, cells``."""
    return derived_once("sheet-rows", spark, sf_dir, lambda: _build_sheet_rows(spark, sf_dir))


def _build_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    cell = "struct<kind:string,text:string>"
    out = None
    for sheet in SHEETS:
        width = len(sheet["columns"])
        typed = spark.sql(spark_sql(_typed_select(sheet)))
        types = {f.name: f.dataType for f in typed.schema.fields}

        def made(name: str):
            text = text_of(F.col(name), types[name])
            return F.when(F.col(name).isNotNull(), F.struct(F.lit(kind_of(types[name])).alias("kind"), text.alias("text")))

        body = typed.select("row_no", F.array(*[made(f"c{i}") for i in range(width)]).alias("cells"))
        title_rows = [*sheet["preamble"], [t for t, _ in sheet["columns"]]]
        literal = [
            F.struct(
                F.lit(i).cast("bigint").alias("row_no"),
                F.array(*[F.struct(F.lit("str").alias("kind"), F.lit(t).alias("text")) for t in row])
                .cast(f"array<{cell}>").alias("cells"),
            )
            for i, row in enumerate(title_rows)
        ]
        above = spark.range(0, 1, 1, 1).select(F.explode(F.array(*literal)).alias("r")).select("r.*")
        parts = body.unionByName(above)
        if sheet["trailing"]:
            last = typed.agg(F.max("row_no").alias("m"))
            parts = parts.unionByName(
                last.select(
                    F.explode(F.sequence(F.col("m") + 1, F.col("m") + sheet["trailing"])).alias("row_no"),
                    F.array_repeat(F.lit(None).cast(cell), width).alias("cells"),
                )
            )
        one = parts.select(F.lit(BOOK).alias("file"), F.lit(sheet["sheet"]).alias("sheet"), "row_no", "cells")
        out = one if out is None else out.unionByName(one)
    return out


def _sql_text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def duck_cells() -> str:
    """The same workbook in DuckDB as CTEs ``cells(sheet,row_no,col_index,kind,text)`` and ``sheet_rows(sheet,row_no)``."""
    ctes, cells, rows = [], [], []
    for sheet in SHEETS:
        name = sheet["sheet"]
        view = "t_" + name.lower()
        ctes.append(f"{view} AS ({duck_sql(_typed_select(sheet))})")
        rows.append(f"SELECT '{name}' AS sheet, row_no FROM {view}")
        for i, (_, e) in enumerate(sheet["columns"]):
            kind = SQL_KINDS.get(e)
            if kind is None:
                kind = "float" if "o_totalprice END" in e else "datetime" if "o_orderdate END" in e else "int" if "AS bigint) END" in e else "str"
            cells.append(f"SELECT '{name}' AS sheet, row_no, {i} AS col_index, CASE WHEN c{i} IS NOT NULL THEN '{kind}' END AS kind, "
                         f"cast(c{i} AS varchar) AS text FROM {view}")
        for r, row in enumerate([*sheet["preamble"], [t for t, _ in sheet["columns"]]]):
            rows.append(f"SELECT '{name}', {r}::bigint")
            for i, t in enumerate(row):
                cells.append(f"SELECT '{name}', {r}::bigint, {i}, 'str', {_sql_text(t)}")
        if sheet["trailing"]:
            rows.append(f"SELECT '{name}', unnest(range(m + 1, m + 1 + {sheet['trailing']})) FROM (SELECT max(row_no) AS m FROM {view})")
    ctes.append("cells AS MATERIALIZED (" + " UNION ALL ".join(cells) + ")")
    ctes.append("sheet_rows AS (" + " UNION ALL ".join(rows) + ")")
    return ",\n".join(ctes)
