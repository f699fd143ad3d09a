"""Layout, cell typing and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.casts import typed_cell
from ledgerloom.functions.text import norm_name, snake
from ledgerloom.operators import headers as H, profile as P, rules as R
from ledgerloom.session import durable
from registered import oracle as O
from registered.inputs import messy_sales, sheet_rows

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def joined(c: str) -> F.Column:
    return F.array_join(c, "|")


def body(spark, d):
    """Workbook rows, sheets, titles and cells."""
    rows = sheet_rows(spark, d)
    rows = H.trim_trailing_blank(rows)
    sheets = durable(H.classify_sheets(rows), "sheets")
    return rows, sheets, H.sheet_columns(sheets), H.melt_cells(H.data_rows(rows, sheets))


@query(
    "cell_typing",
    O.with_(O.messy()) + """, v AS (SELECT unnest([account_id_raw, qty_raw, net_sales_raw, '-'||qty_raw||'.5', order_date_raw, '']) AS v FROM messy),
typed AS (SELECT CASE WHEN v='' OR v IS NULL THEN NULL WHEN regexp_full_match(v,'-?[0-9]*\\.?[0-9]*') AND regexp_matches(v,'[0-9]')
   THEN CASE WHEN contains(v,'.') THEN 'float' ELSE 'int' END ELSE 'str' END AS kind, v FROM v)
SELECT kind, CASE kind WHEN 'float' THEN cast(cast(v AS double) AS varchar) WHEN 'int' THEN cast(cast(v AS hugeint) AS varchar) WHEN 'str' THEN v END AS text,
  count(*) AS n FROM typed GROUP BY 1,2""",
)
def cell_typing(spark, d):
    m = messy_sales(spark, d)
    texts = F.array("account_id_raw", "qty_raw", "net_sales_raw", F.concat(F.lit("-"), "qty_raw", F.lit(".5")), "order_date_raw", F.lit(""))
    cells = m.select(F.explode(texts).alias("v")).select(typed_cell(F.col("v")).alias("c"))
    return cells.groupBy("c.kind", "c.text").agg(F.count(F.lit(1)).alias("n"))


@query("trim_trailing_blank", O.with_(O.layout()) + """SELECT r.sheet, count(*) AS rows_kept, max(r.row_no) AS last_row
FROM sheet_rows r JOIN trimmed t ON r.sheet=t.sheet AND r.row_no<=t.last_no GROUP BY 1""")
def trim_trailing_blank(spark, d):
    return H.trim_trailing_blank(sheet_rows(spark, d)).groupBy("sheet").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.max("row_no").alias("last_row")
    )


@query("blank_rows", O.with_(O.layout()) + f"""SELECT sheet, row_no FROM sheet_rows r WHERE NOT EXISTS
 (SELECT 1 FROM cells c WHERE c.sheet=r.sheet AND c.row_no=r.row_no AND {O.filled('c.text')})""")
def blank_rows(spark, d):
    return H.blank_rows(sheet_rows(spark, d)).select("sheet", "row_no")


@query("detect_header", O.with_(O.layout()) + "SELECT sheet, header_row FROM headers")
def detect_header(spark, d):
    return H.detect_header(sheet_rows(spark, d)).select("sheet", "header_row")


@query("classify_sheets", O.with_(O.layout()) + "SELECT sheet, kind, header_row, width, data_rows FROM kinds")
def classify_sheets(spark, d):
    return H.classify_sheets(H.trim_trailing_blank(sheet_rows(spark, d))).select(
        "sheet", "kind", "header_row", F.col("width").cast("bigint").alias("width"), "data_rows"
    )


@query("melt_cells", O.with_(O.layout()) + """SELECT b.sheet, b.row_no, t.source, b.kind, b.text FROM body b JOIN titles t USING (sheet,col_index)""")
def melt_cells(spark, d):
    _, _, titles, cells = body(spark, d)
    text = F.when(~F.col("text").rlike(r"^\s*$"), F.col("text"))
    return (
        cells.join(titles, P.COLUMN)
        .select("sheet", "row_no", "source", F.when(text.isNotNull(), F.col("kind")).alias("kind"), text.alias("text"))
    )


STATS = 'sheet, col_index, row_count, type, null_rate, "distinct", "min", "max", first_text'


@query("infer_types", O.with_(O.profile()) + "SELECT sheet, col_index, type FROM stats")
def infer_types(spark, d):
    cells = body(spark, d)[3]
    return P.column_stats(P.weighted_values(cells)).select("sheet", "col_index", "type")


@query("column_flags", O.with_(O.profile()) + 'SELECT sheet, col_index, all_zero, leading_zero, big_int, "constant", is_currency, "numeric" FROM stats')
def column_flags(spark, d):
    cells = body(spark, d)[3]
    return P.column_stats(P.weighted_values(cells)).select(
        "sheet", "col_index", "all_zero", "leading_zero", "big_int", "constant", "is_currency", "numeric"
    )


@query("infer_roles", O.with_(O.profile()) + "SELECT sheet, source, canonical, role FROM prof")
def infer_roles(spark, d):
    _, _, titles, cells = body(spark, d)
    return P.profile_columns(cells, titles, samples=False).select("sheet", "source", "canonical", "role")


@query("target_types", O.with_(O.profile()) + "SELECT sheet, source, type, role, ttype FROM prof")
def target_types(spark, d):
    _, _, titles, cells = body(spark, d)
    return P.profile_columns(cells, titles, samples=False).select("sheet", "source", "type", "role", "ttype")


PROFILE_SQL = O.profile() + """,
firsts AS (SELECT sheet, col_index, text, min(row_no) AS first_pos FROM body WHERE text IS NOT NULL GROUP BY 1,2,3),
d30 AS (SELECT sheet, col_index, string_agg(text,'|' ORDER BY first_pos) AS distinct_sample FROM
  (SELECT *, row_number() OVER (PARTITION BY sheet,col_index ORDER BY first_pos) AS r FROM firsts) WHERE r<=30 GROUP BY 1,2),
s5 AS (SELECT sheet, col_index, string_agg(text,'|' ORDER BY row_no) AS sample, string_agg(text,', ' ORDER BY row_no) FILTER (WHERE r<=2) AS two FROM
  (SELECT *, row_number() OVER (PARTITION BY sheet,col_index ORDER BY row_no) AS r FROM body WHERE text IS NOT NULL) WHERE r<=5 GROUP BY 1,2)"""


@query("profile_columns", O.with_(PROFILE_SQL) + """SELECT p.sheet, p.col_index, p.source, p.row_count, p.type, p.null_rate, p."distinct", p."min", p."max",
 coalesce(sample,'') AS sample, coalesce(distinct_sample,'') AS distinct_sample FROM prof p LEFT JOIN s5 USING (sheet,col_index) LEFT JOIN d30 USING (sheet,col_index)""")
def profile_columns(spark, d):
    _, _, titles, cells = body(spark, d)
    return P.profile_columns(cells, titles).select(
        "sheet", "col_index", "source", "row_count", "type", "null_rate", "distinct", "min", "max",
        joined("sample").alias("sample"), joined("distinct_sample").alias("distinct_sample"),
    )


RULES_SQL = PROFILE_SQL + """,
tok AS (SELECT sheet, col_index, list_sort(list(DISTINCT trim(regexp_extract(text, '(?i)(^|[^a-z])(employee|salesrep|sales ?rep|sample|comp|complimentary|donation|staff|internal|supplier|house ?account|admin)([^a-z]|$)', 2))))[1:6] AS tokens
  FROM body WHERE regexp_matches(text, '(?i)(^|[^a-z])(employee|salesrep|sales ?rep|sample|comp|complimentary|donation|staff|internal|supplier|house ?account|admin)([^a-z]|$)') GROUP BY 1,2),
pick AS (SELECT p.sheet, min(row(col_index,source)) FILTER (WHERE lower(source)='date' OR (type='date' AND source ILIKE '%date%')) AS dc,
  min(row(col_index,source)) FILTER (WHERE lower(source)='time' OR type='time') AS tc,
  min(row(col_index,source)) FILTER (WHERE type='number' AND regexp_matches(source,'(?i)(qty|quantity|units?|sold|cases?)')) AS qc,
  min(row(col_index,source,null_rate)) FILTER (WHERE type='string' AND role<>'id' AND regexp_matches(source,'(?i)(customer|account|name|store|outlet|client)')) AS nc,
  min(row(col_index,source,tokens)) FILTER (WHERE type='string' AND tokens IS NOT NULL) AS ic
  FROM prof p LEFT JOIN tok USING (sheet,col_index) GROUP BY 1),
reasoned AS (SELECT *, CASE WHEN type='empty' THEN 'always empty' WHEN all_zero THEN 'always zero' ELSE 'single constant value' END AS reason FROM prof),
rl AS (SELECT sheet, 1 AS s, -1 AS ci, 1 AS sub, 'select_sheet' AS kind, 'Read sheet "'||sheet||'" as data' AS title, true AS enabled, 'It holds a table.' AS why FROM kinds WHERE kind='data'
 UNION ALL SELECT sheet,2,-1,1,'header_row','Titles are in row '||(header_row+1)||'',true,'What stands above is no data.' FROM kinds WHERE kind='data' AND header_row>0
 UNION ALL SELECT sheet,3,col_index,1,'cast','Keep "'||source||'" as text',true,'Codes may lose digits when held as numbers.' FROM prof WHERE role='id' AND (big_int OR "numeric") AND NOT leading_zero
 UNION ALL SELECT sheet,3,col_index,2,'cast','Read "'||source||'" as an amount',true,'For example '||coalesce(two,'') FROM prof LEFT JOIN s5 USING (sheet,col_index) WHERE is_currency
 UNION ALL SELECT sheet,3,col_index,3,'cast','Write "'||source||'" as ISO dates',true,'Dates come in more than one form.' FROM prof WHERE type='date'
 UNION ALL SELECT sheet,4,-1,1,'combine_datetime','Join "'||dc[2]||'" and "'||tc[2]||'" to a timestamp',true,'The moment is spread over two columns.' FROM pick WHERE dc[1]<>tc[1]
 UNION ALL SELECT sheet,5,col_index,1,'drop_column','Drop "'||source||'" ('||reason||')',true,'Nothing to learn from it ('||reason||').' FROM reasoned WHERE role='ignore'
 UNION ALL SELECT sheet,6,-1,1,'filter','Leave out internal rows by "'||ic[2]||'"',true,'Some values name insiders: '||array_to_string(ic[3],', ')||'.' FROM pick WHERE ic IS NOT NULL
 UNION ALL SELECT sheet,7,-1,1,'filter','Leave out rows whose "'||qc[2]||'" is zero or empty',false,'Such rows may stand for nothing; not applied unless chosen.' FROM pick WHERE qc IS NOT NULL
 UNION ALL SELECT sheet,8,-1,1,'filter','Leave out rows without "'||nc[2]||'"',true,cast(cast(round(nc[3]*100) AS int) AS varchar)||'% of the rows lack it.' FROM pick WHERE nc[3]>0.001 AND nc[3]<=0.5
 UNION ALL SELECT sheet,9,-1,1,'dedupe','Leave out repeated rows',false,'Not applied unless chosen.' FROM kinds WHERE kind='data')"""


def rules_of(spark, d, samples: bool = True):
    rows, sheets, titles, cells = body(spark, d)
    values = durable(P.weighted_values(cells), "values")
    prof = P.describe_columns(P.column_stats(values), titles)
    if samples:
        prof = prof.join(P.column_samples(cells, values), P.COLUMN, "left")
        prof = prof.withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))
    prof = durable(prof, "profile")
    return prof, R.generate_rules(prof, values, sheets), sheets


@query("generate_rules", O.with_(RULES_SQL) + """SELECT sheet, 'r'||row_number() OVER (PARTITION BY sheet ORDER BY s,ci,sub) AS id, kind, title, enabled, why FROM rl""")
def generate_rules(spark, d):
    return rules_of(spark, d)[1].select("sheet", "id", "kind", "title", "enabled", "why")


@query("generate_schema", O.with_(RULES_SQL) + f""", cmb AS (SELECT sheet, dc[2] AS ds, tc[2] AS ts FROM pick WHERE dc[1]<>tc[1]),
cols AS (SELECT sheet, col_index, canonical AS name, ttype AS type, role, source, NULL::varchar AS time_source FROM prof p WHERE role<>'ignore'
  AND NOT EXISTS (SELECT 1 FROM cmb WHERE cmb.sheet=p.sheet AND p.source IN (ds,ts))
 UNION ALL SELECT sheet,-1,'event_timestamp','timestamp','timestamp',ds,ts FROM cmb)
SELECT sheet, {O.snake('sheet')} AS table_name, cast(row_number() OVER (PARTITION BY sheet ORDER BY col_index) AS int) AS position, name, type, role, source, time_source FROM cols""")
def generate_schema(spark, d):
    _, _, titles, cells = body(spark, d)
    return R.generate_schema(P.profile_columns(cells, titles, samples=False)).select(
        "sheet", "table_name", "position", "name", "type", "role", "source", "time_source"
    )


@query("guess_format", O.with_(O.layout()) + """, h AS (SELECT sheet, lower(string_agg(source,' ' ORDER BY col_index)) AS h FROM titles GROUP BY 1)
SELECT sheet, CASE WHEN regexp_matches(h,'supplier key|supplier''s sku|product key') THEN 'vendor-multi-sheet-report'
 WHEN regexp_matches(h,'time zone|price point|modifiers applied') THEN 'pos-transaction-export'
 WHEN regexp_matches(h,'importer|depletion|account region|sales rep') THEN 'distributor-depletion' ELSE 'flat-tabular' END AS format_guess FROM h""")
def guess_format(spark, d):
    return R.guess_format(body(spark, d)[2]).select("sheet", "format_guess")


NAMES = "SELECT unnest([customer_name_raw, account_id_raw, sku_raw, item_raw, order_date_raw, net_sales_raw, supplier_raw]) AS v FROM messy"
NAME_COLUMNS = ["customer_name_raw", "account_id_raw", "sku_raw", "item_raw", "order_date_raw", "net_sales_raw", "supplier_raw"]


@query("snake_names", O.with_(O.messy(), f"v AS ({NAMES})") + f"SELECT {O.snake('v')} AS name, count(*) AS n FROM v GROUP BY 1")
def snake_names(spark, d):
    v = messy_sales(spark, d).select(F.explode(F.array(*NAME_COLUMNS)).alias("v"))
    return v.groupBy(snake(F.col("v")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_names", O.with_(O.messy(), f"v AS ({NAMES})") + f"SELECT {O.norm('v')} AS name, count(*) AS n FROM v GROUP BY 1")
def normalize_names(spark, d):
    v = messy_sales(spark, d).select(F.explode(F.array(*NAME_COLUMNS)).alias("v"))
    return v.groupBy(norm_name(F.col("v")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
