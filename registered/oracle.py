"""DuckDB SQL building blocks shared by the comparison queries."""

from __future__ import annotations

from registered.inputs import MESSY_SALES, duck_cells, duck_sql


def blank(c: str) -> str:
    return f"({c} IS NULL OR regexp_full_match({c}, '\\s*'))"


def filled(c: str) -> str:
    return f"NOT {blank(c)}"


def snake(c: str) -> str:
    inner = f"trim(regexp_replace(lower(coalesce({c},'')),'[^a-z0-9]+','_','g'),'_')"
    return f"coalesce(nullif(regexp_replace({inner},'^([0-9])','col_\\1'),''),'column')"


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}),'[^a-z0-9]+',' ','g'))"


NUMERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: str, drop: str = r"[,$%\s]") -> str:
    x = f"regexp_replace({c},'{drop}','','g')"
    return f"CASE WHEN regexp_matches({x},'{NUMERAL}') THEN try_cast({x} AS double) END"


def iso_date(c: str) -> str:
    t = f"trim({c})"
    a, b = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4})"
    ex = lambda p, i: f"regexp_extract({t},'{p}',{i})"
    year = f"CASE WHEN length({ex(b,3)})=4 THEN {ex(b,3)} ELSE '20'||{ex(b,3)} END"
    return (
        f"CASE WHEN regexp_matches({t},'{a}') THEN {ex(a,1)}||'-'||lpad({ex(a,2)},2,'0')||'-'||lpad({ex(a,3)},2,'0') "
        f"WHEN regexp_matches({t},'{b}') THEN ({year})||'-'||lpad({ex(b,1)},2,'0')||'-'||lpad({ex(b,2)},2,'0') ELSE {t} END"
    )


def time_text(c: str) -> str:
    p = "([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
    ex = lambda i: f"regexp_extract({c},'{p}',{i})"
    return (
        f"CASE WHEN regexp_matches({c},'{p}') THEN lpad({ex(1)},2,'0')||':'||{ex(2)}||':'||coalesce(nullif({ex(3)},''),'00') "
        "ELSE '00:00:00' END"
    )


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def messy() -> str:
    return f"messy AS MATERIALIZED (SELECT *, row(l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS pos FROM ({duck_sql(MESSY_SALES)}))"


# --- workbook layout ---------------------------------------------------------------------------
META = (
    "^(filters?|extra ?info|.*info|cover|notes?|readme|summary|legend|parameters?|settings?)$"
)


def layout() -> str:
    """headers(sheet, header_row) and sheets(sheet, kind, header_row, width, data_rows)."""
    return duck_cells() + f""",
fills AS (SELECT r.sheet, r.row_no, count(c.text) FILTER (WHERE {filled('c.text')}) AS fill,
   count(*) FILTER (WHERE c.kind='str' AND {filled('c.text')} AND length(c.text)<60
                    AND NOT regexp_full_match(trim(c.text),'-?[0-9]+(\\.[0-9]+)?')) AS titles
  FROM (SELECT * FROM sheet_rows WHERE row_no<30) r LEFT JOIN (SELECT * FROM cells WHERE row_no<30) c USING (sheet,row_no)
  GROUP BY 1,2),
trimmed AS (SELECT sheet, max(row_no) AS last_no FROM cells WHERE {filled('text')} GROUP BY 1),
scored AS (SELECT a.sheet, a.row_no, a.titles*2 + least(avg(b.fill), a.fill) - a.row_no*0.6::double AS score
  FROM fills a JOIN fills b ON a.sheet=b.sheet AND b.row_no BETWEEN a.row_no+1 AND a.row_no+5 AND b.fill>0
  WHERE a.row_no<25 AND a.fill>=2 GROUP BY a.sheet,a.row_no,a.titles,a.fill HAVING avg(b.fill)>=2),
headers AS (SELECT sheet, arg_max(row_no, row(score,-row_no)) AS header_row FROM scored GROUP BY 1),
sheets AS (SELECT h.sheet, h.header_row,
   (SELECT count(*) FROM cells c WHERE c.sheet=h.sheet AND c.row_no=h.header_row AND {filled('c.text')}) AS width,
   (SELECT count(*) FROM sheet_rows r JOIN trimmed t ON t.sheet=r.sheet AND r.row_no<=t.last_no WHERE r.sheet=h.sheet AND r.row_no>h.header_row) AS data_rows
  FROM headers h),
kinds AS (SELECT *, CASE WHEN width<3 OR data_rows<1 OR (regexp_matches(lower(trim(sheet)),'{META}') AND width<4)
   THEN 'metadata' ELSE 'data' END AS kind FROM sheets),
titles AS (SELECT c.sheet, c.col_index, CASE WHEN {blank('c.text')} THEN 'column_'||(c.col_index+1) ELSE trim(c.text) END AS source
  FROM cells c JOIN kinds k ON c.sheet=k.sheet AND c.row_no=k.header_row WHERE k.kind='data'),
live AS (SELECT DISTINCT c.sheet, c.row_no FROM cells c JOIN kinds k ON c.sheet=k.sheet
  WHERE k.kind='data' AND c.row_no>k.header_row AND {filled('c.text')}),
body AS MATERIALIZED (SELECT l.sheet, l.row_no, t.col_index, CASE WHEN {filled('c.text')} THEN c.kind END AS kind,
   CASE WHEN {filled('c.text')} THEN c.text END AS text
  FROM live l JOIN titles t ON l.sheet=t.sheet LEFT JOIN cells c ON c.sheet=l.sheet AND c.row_no=l.row_no AND c.col_index=t.col_index)"""


def profile() -> str:
    """stats and prof (one row per sheet column) on top of layout()."""
    num = number("text")
    return layout() + f""",
vals AS (SELECT *, trim(text) AS t, {num} AS num FROM body),
sums AS (SELECT sheet, col_index, count(*) AS row_count, count(text) AS filled, count(DISTINCT text) AS distinct_n,
  count(*) FILTER (WHERE text IS NOT NULL AND (kind='bool' OR (kind='str' AND lower(t) IN ('true','false','yes','no','y','n','t','f')))) AS w_bool,
  count(*) FILTER (WHERE text IS NOT NULL AND (kind IN ('date','datetime') OR (kind='str' AND regexp_matches(text,'^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}')))) AS w_date,
  count(*) FILTER (WHERE text IS NOT NULL AND (kind='time' OR (kind='str' AND regexp_matches(lower(t),'^[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?(\\s?[ap]m)?$')))) AS w_time,
  count(*) FILTER (WHERE (regexp_matches(t,'^-?\\$\\s?[0-9,]+(\\.[0-9]+)?$') OR regexp_matches(t,'^-?[0-9,]+\\.[0-9]{{2}}$')) AND NOT regexp_matches(t,'^-?[0-9]+$')) AS w_curr,
  count(*) FILTER (WHERE kind='str' AND contains(text,'$')) AS w_dollar,
  count(*) FILTER (WHERE text IS NOT NULL AND (kind IN ('int','float') OR (kind='str' AND regexp_matches(t,'^-?[0-9,]+(\\.[0-9]+)?$')))) AS w_num,
  count(*) FILTER (WHERE regexp_matches(t,'^0[0-9]+$')) AS w_zero,
  coalesce(bool_and(coalesce(num=0,false)) FILTER (WHERE text IS NOT NULL),false) AS only_zero,
  coalesce(bool_and(kind IN ('int','float') AND coalesce(num=floor(num) AND abs(num)>=1e8,false)) FILTER (WHERE text IS NOT NULL),false) AS only_big,
  min(num) AS low, max(num) AS high, arg_min(text,row_no) FILTER (WHERE text IS NOT NULL) AS first_text
  FROM vals GROUP BY 1,2),
f AS (SELECT *, filled=0 AS empty, distinct_n<=2 AND w_bool>0.9*filled AND filled>0 AS isbool,
   (w_curr>0.6*filled OR w_dollar>0.5*filled) AND filled>0 AS is_currency, w_num>0.85*filled AND filled>0 AS numeric_ FROM sums),
stats AS (SELECT sheet, col_index, row_count,
   CASE WHEN empty THEN 'empty' WHEN isbool THEN 'boolean' WHEN w_date>0.8*filled THEN 'date' WHEN w_time>0.8*filled THEN 'time'
        WHEN is_currency THEN 'currency' WHEN numeric_ THEN 'number' ELSE 'string' END AS type,
   CASE WHEN empty THEN 1.0::double ELSE round((row_count-filled)/row_count::double,4) END AS null_rate, distinct_n AS "distinct",
   CASE WHEN numeric_ OR is_currency THEN low END AS "min", CASE WHEN numeric_ OR is_currency THEN high END AS "max",
   numeric_ AND only_zero AS all_zero, w_zero>0.5*filled AND filled>0 AS leading_zero, numeric_ AND only_big AS big_int,
   empty OR distinct_n=1 AS "constant", is_currency, numeric_ AS "numeric", first_text FROM f),
roles AS (SELECT s.*, t.source, {snake('t.source')} AS canonical,
   CASE WHEN type='empty' OR all_zero OR ("constant" AND row_count>=3) THEN 'ignore'
        WHEN type IN ('date','time') OR regexp_matches(t.source,'(?i)(date|day|month|year|period)') OR regexp_matches(t.source,'(?i)\\btime\\b') THEN 'timestamp'
        WHEN regexp_matches(t.source,'(?i)(sku|upc|ean|gtin|barcode|code|key|id$|_id|\\bid\\b)') OR leading_zero OR big_int THEN 'id'
        WHEN type IN ('number','currency') THEN 'measure' ELSE 'dimension' END AS role
  FROM stats s JOIN titles t USING (sheet,col_index)),
prof AS MATERIALIZED (SELECT *, CASE WHEN role='id' THEN 'string' WHEN type='currency' THEN 'decimal' WHEN role='timestamp' OR type='date' THEN 'date'
   WHEN type='time' THEN 'time' WHEN type='number' AND coalesce(try_cast(first_text AS double)=floor(try_cast(first_text AS double)),false)
      AND NOT regexp_matches(source,'(?i)(qty|quantity|units?|sold|cases?|bottles?|amount|amt|revenue|sales|net|gross|price|cost|fob|msrp|total|count|sum|volume|liters?)') THEN 'integer'
   WHEN type='number' THEN 'decimal' ELSE 'string' END AS ttype FROM roles)"""
