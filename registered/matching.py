"""Entity matching, grouping and conforming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.similarity import name_similarity, partial_ratio, token_sort_ratio
from ledgerloom.functions.text import norm_name
from ledgerloom.operators import clean as C, conform as U, grouping as G, match as M, profile as P, registry as E, rules as R, siblings as S
from ledgerloom.operators.headers import SHEET
from ledgerloom.session import scratch_path
from registered import oracle as O
from registered.cleaning import RULES, SCHEMA, clean_sql, messy_sheet
from registered.inputs import MESSY_TITLES, ORDER_KEY, derived_once, messy_sales, register
from registered.sheets import body

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- inputs ------------------------------------------------------------------------------------
def book_profile(spark, d):
    """Column profile of the workbook, without examples."""

    def build():
        _, _, titles, cells = body(spark, d)
        return P.profile_columns(cells, titles, samples=False)

    return derived_once("book-profile", spark, d, build)


TABS = [f"Sales of {m:02d}" for m in range(1, 13)]


def tab_title(month: int, column: str) -> str:
    return "QTY Ordered" if column == "qty_raw" and month % 2 else MESSY_TITLES[column]


def tab_profile(spark, d):
    """Profile of the messy sales split into one tab per month."""

    def build():
        m = messy_sales(spark, d)
        sheet = F.concat(F.lit("Sales of "), F.lpad(F.col("month_no").cast("string"), 2, "0"))
        pairs = [F.struct(F.when(F.col(c).isNotNull(), "str").alias("kind"), F.col(c).alias("text")) for c in MESSY_TITLES]
        cells = m.select(F.lit("tabs.xlsx").alias("file"), sheet.alias("sheet"), F.col("pos").alias("row_no"),
                         F.posexplode(F.array(*pairs)).alias("col_index", "cell")).select(*SHEET, "row_no", "col_index", "cell.*")
        titles = spark.createDataFrame(
            [("tabs.xlsx", TABS[k - 1], i, tab_title(k, c)) for k in range(1, 13) for i, c in enumerate(MESSY_TITLES)],
            "file string, sheet string, col_index int, source string",
        )
        return P.profile_columns(cells, titles, samples=False)

    return derived_once("tab-profile", spark, d, build)


def all_profiles(spark, d):
    return book_profile(spark, d).unionByName(tab_profile(spark, d))


def matches(spark, d):
    return derived_once("matches", spark, d, lambda: M.match_columns(all_profiles(spark, d), E.SEED))


# --- SQL ---------------------------------------------------------------------------------------
def lcs_sql(a: str, b: str) -> str:
    ones = f"((1::bigint << length({a})) - 1)"
    mask = (f"coalesce(list_reduce(list_transform(range(1,length({a})+1), lambda i: CASE WHEN {a}[i]=c THEN 1::bigint << (i-1) ELSE 0::bigint END), "
            "lambda p, q: p | q), 0::bigint)")
    return (f"(length({a}) - bit_count(list_reduce(list_transform(string_split({b},''), lambda c: {mask}), "
            f"lambda s, m: ((s + (s & m)) | (s - (s & m))) & {ones}, {ones})))")


def sorted_sql(a: str) -> str:
    return f"array_to_string(list_sort(string_split({a},' ')),' ')"


def sim_ctes(pairs: str) -> str:
    """sims(a, b, ts, pr, sim) for the distinct non-empty pairs of ``pairs(a, b)``."""
    return f"""pr0 AS (SELECT DISTINCT a, b, {sorted_sql('a')} AS sa, {sorted_sql('b')} AS sb FROM {pairs}),
ways AS (SELECT a, b, a AS x, b AS y FROM pr0 WHERE length(a)<=length(b) UNION ALL SELECT a, b, b, a FROM pr0 WHERE length(b)<=length(a)),
wins AS (SELECT DISTINCT a, b, x, unnest(list_transform(range(2-length(x), length(y)+1), lambda s: substr(y, greatest(s,1), least(s+length(x)-1,length(y))-greatest(s,1)+1))) AS w FROM ways),
prs AS (SELECT a, b, max({lcs_sql('x','w')}*200.0::double/(length(x)+length(w))) AS pr FROM wins GROUP BY 1,2),
sims AS MATERIALIZED (SELECT a, b, ts, pr, (0.7::double*ts+0.3::double*pr)/100.0::double AS sim FROM
  (SELECT a, b, {lcs_sql('sa','sb')}*200.0::double/(length(sa)+length(sb)) AS ts FROM pr0) JOIN prs USING (a,b))"""


def registry_values() -> str:
    rows = [
        f"({i},'{e['name']}','{e['role']}','{e['type']}','{e['expect']}','{n}')"
        for i, e in enumerate(E.SEED)
        for n in dict.fromkeys([M._normal(e["name"]), *[M._normal(a) for a in e["aliases"]]])
    ]
    return f"reg(ord, entity, role, type, expect, form) AS (VALUES {', '.join(rows)})"


BONUS = """CASE expect WHEN 'number' THEN CASE WHEN type IN ('number','currency') THEN 1.0 ELSE 0.7 END
  WHEN 'date' THEN CASE WHEN type IN ('date','time') THEN 1.0 ELSE 0.72 END
  WHEN 'id' THEN CASE WHEN leading_zero OR big_int OR role='id' THEN 1.0 ELSE 0.8 END
  WHEN 'text' THEN CASE type WHEN 'boolean' THEN 0.4 WHEN 'string' THEN 1.0 ELSE 0.8 END ELSE 0.95 END::double"""

# Types and roles of the messy columns are stated here; the profile queries check how they are found.
TAB_SHAPES = {
    "order_date_raw": ("date", False, "timestamp"), "time_raw": ("time", False, "timestamp"), "customer_name_raw": ("string", False, "dimension"),
    "account_id_raw": ("number", True, "id"), "sku_raw": ("number", True, "id"), "item_raw": ("string", False, "dimension"),
    "qty_raw": ("number", False, "measure"), "net_sales_raw": ("currency", False, "measure"), "supplier_raw": ("string", False, "dimension"),
    "state_raw": ("string", False, "dimension"), "channel_raw": ("string", False, "dimension"), "currency_raw": ("string", False, "ignore"),
}


def match_sql() -> str:
    """allcols(file, sheet, col_index, source, type, leading_zero, big_int, role) and matched with the winner."""
    tab_rows = ", ".join(
        f"({k},{i},'{tab_title(k, c)}','{t}',{str(z).lower()},'{r}')"
        for k in range(1, 13) for i, (c, (t, z, r)) in enumerate(TAB_SHAPES.items())
    )
    return O.profile() + f""",
{O.messy()}, {registry_values()},
months AS (SELECT DISTINCT month_no FROM messy),
tabcols(k, col_index, source, type, leading_zero, role) AS (VALUES {tab_rows}),
allcols AS (SELECT 'book.xlsx' AS file, sheet, col_index, source, canonical, type, leading_zero, big_int, role FROM prof
 UNION ALL SELECT 'tabs.xlsx', 'Sales of '||lpad(k::varchar,2,'0'), col_index, source, {O.snake('source')}, type, leading_zero, false, role FROM tabcols JOIN months ON k=month_no),
cand AS (SELECT DISTINCT {O.norm('source')} AS a, form AS b FROM allcols, reg),
{sim_ctes('cand')},
base AS (SELECT title, ord, entity, expect, bool_or(title=form) AS alias, CASE WHEN bool_or(title=form) THEN 0.99::double ELSE max(sim) END AS base
  FROM (SELECT DISTINCT {O.norm('source')} AS title FROM allcols) JOIN reg ON true JOIN sims ON a=title AND b=form GROUP BY 1,2,3,4),
ranked AS (SELECT c.*, b.entity, b.ord, b.alias, round(base*({BONUS.replace('type','c.type').replace('role=','c.role=')}),4) AS score,
  row_number() OVER (PARTITION BY file,sheet,col_index ORDER BY round(base*({BONUS.replace('type','c.type').replace('role=','c.role=')}),4) DESC, alias DESC, ord) AS r
  FROM allcols c JOIN base b ON b.title={O.norm('c.source')}),
matched AS MATERIALIZED (SELECT file, sheet, col_index, source, canonical, type, role,
  CASE WHEN max(score) FILTER (WHERE r=1)>=0.62 THEN max(entity) FILTER (WHERE r=1) END AS entity, max(score) FILTER (WHERE r=1) AS confidence,
  CASE WHEN max(score) FILTER (WHERE r=1)<0.62 THEN 'none' WHEN bool_or(alias) FILTER (WHERE r=1) THEN 'alias' ELSE 'fuzzy' END AS via,
  max(score) FILTER (WHERE r=1)<0.62 AS suggest_new,
  CASE WHEN max(score) FILTER (WHERE r=1)>=0.62 THEN string_agg(entity,'|' ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 4) ELSE string_agg(entity,'|' ORDER BY r) FILTER (WHERE r<=3) END AS alternatives
  FROM ranked GROUP BY 1,2,3,4,5,6,7)"""


MATCH = O.with_(match_sql())


@query("name_similarity", O.with_(f"pairs AS (SELECT DISTINCT {O.norm('p_name')} AS a, {O.norm(chr(112)+'_brand||chr(32)||p_type||chr(32)||p_name')} AS b FROM part)", sim_ctes("pairs"))
       + "SELECT a, b, round(ts,6) AS token_sort, round(pr,6) AS partial, round(sim,6) AS similarity FROM sims")
def similarity_query(spark, d):
    register(spark, d)
    p = spark.table("part").select(norm_name(F.col("p_name")).alias("a"), norm_name(F.concat_ws(" ", "p_brand", "p_type", "p_name")).alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", F.round(token_sort_ratio(a, b), 6).alias("token_sort"), F.round(partial_ratio(a, b), 6).alias("partial"),
                    F.round(name_similarity(a, b), 6).alias("similarity"))


@query("type_bonus", O.with_(O.profile()) + f"SELECT sheet, source, expect, {BONUS} AS bonus FROM prof, (VALUES ('number'),('date'),('id'),('text'),('other')) e(expect)")
def type_bonus(spark, d):
    p = book_profile(spark, d).withColumn("expect", F.explode(F.array(*[F.lit(x) for x in ("number", "date", "id", "text", "other")])))
    return p.select("sheet", "source", "expect", M.type_bonus(F.col("expect"), F.col("type"), F.col("leading_zero"), F.col("big_int"), F.col("role")).alias("bonus"))


@query("registry", O.with_(registry_values(), O.messy()) + f""", seen AS (SELECT unnest(['customer','product','vendor','region','channel']) AS entity,
 unnest([customer_name_raw,item_raw,supplier_raw,state_raw,channel_raw]) AS v FROM messy)
SELECT entity, role, type, expect, count(DISTINCT form) AS names, coalesce((SELECT count(DISTINCT v) FROM seen s WHERE s.entity=reg.entity AND NOT {O.blank('v')}),0) AS values_seen
FROM reg GROUP BY 1,2,3,4""")
def registry(spark, d):
    m = messy_sales(spark, d)
    fields = {"customer": "customer_name_raw", "product": "item_raw", "vendor": "supplier_raw", "region": "state_raw", "channel": "channel_raw"}
    seen = m.select(F.explode(F.array(*[F.struct(F.lit(e).alias("entity"), F.col(c).alias("v")) for e, c in fields.items()])).alias("s")).select("s.*")
    counts = seen.filter(~F.col("v").rlike(r"^\s*$")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("values_seen"))
    reg = E.registry_frame(spark, E.read_registry(spark))
    names = F.size(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), norm_name))).cast("bigint")
    return reg.join(counts, reg["name"] == counts["entity"], "left").select(
        F.col("name").alias("entity"), "role", "type", "expect", names.alias("names"), F.coalesce("values_seen", F.lit(0)).alias("values_seen")
    )


@query("match_columns", MATCH + "SELECT file, sheet, source, entity, confidence, via, suggest_new, alternatives FROM matched WHERE file='book.xlsx'")
def match_columns(spark, d):
    out = M.match_columns(book_profile(spark, d), E.SEED)
    alternatives = F.array_join(F.transform("alternatives", lambda x: x["entity"]), "|")
    return out.select("file", "sheet", "source", "entity", "confidence", "via", "suggest_new", alternatives.alias("alternatives"))


@query("match_profile", MATCH + "SELECT file, sheet, col_index, source, canonical, type, role, entity, confidence FROM matched")
def match_profile(spark, d):
    return M.match_columns(all_profiles(spark, d), E.SEED).select("file", "sheet", "col_index", "source", "canonical", "type", "role", "entity", "confidence")


SETS = match_sql() + """,
sets AS (SELECT file, sheet, coalesce(list_sort(list(DISTINCT entity) FILTER (WHERE entity IS NOT NULL)), []) AS ents FROM matched GROUP BY 1,2)"""


@query("entity_sets", O.with_(SETS) + """SELECT s.file, s.sheet, array_to_string(ents,'|') AS entities,
 coalesce((SELECT string_agg(e||'='||src,'|' ORDER BY e) FROM (SELECT entity AS e, arg_min(source,col_index) AS src FROM matched m WHERE m.file=s.file AND m.sheet=s.sheet AND entity IS NOT NULL GROUP BY 1)),'') AS sources FROM sets s""")
def entity_sets(spark, d):
    m = matches(spark, d)
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "entity", "source")))
    sources = M.entity_sources(m).groupBy(*SHEET).agg(F.array_join(pairs, "|").alias("sources"))
    return M.entity_sets(m).join(sources, SHEET, "left").select(
        *SHEET, F.array_join("entities", "|").alias("entities"), F.coalesce("sources", F.lit("")).alias("sources")
    )


GROUPS = SETS + """,
near AS (SELECT a.file, a.sheet AS x, b.sheet AS y FROM sets a JOIN sets b ON a.file=b.file
  WHERE len(a.ents)>0 AND len(b.ents)>0 AND len(list_intersect(a.ents,b.ents))::double/len(list_distinct(a.ents||b.ents))>=0.85),
reach AS (SELECT file, sheet AS x, sheet AS y FROM sets UNION SELECT r.file, r.x, n.y FROM reach r JOIN near n ON n.file=r.file AND n.x=r.y),
grp AS (SELECT file, x AS sheet, min(y) AS first_sheet FROM reach GROUP BY 1,2)"""


@query("union_groups", O.with_(GROUPS) + "SELECT file, sheet, first_sheet FROM grp")
def union_groups(spark, d):
    g = G.union_groups(M.entity_sets(matches(spark, d)))
    heads = g.groupBy("file", "group_id").agg(F.min("sheet").alias("first_sheet"))
    return g.join(heads, ["file", "group_id"]).select("file", "sheet", "first_sheet")


@query("name_groups", O.with_(GROUPS) + f""", sizes AS (SELECT file, first_sheet, count(*) AS members FROM grp GROUP BY 1,2),
sh AS (SELECT file, first_sheet, list_sort(list(e)) AS shared FROM (SELECT g.file, first_sheet, e, count(*) AS c FROM grp g JOIN (SELECT file, sheet, unnest(ents) AS e FROM sets) s USING (file,sheet) GROUP BY 1,2,3)
  JOIN sizes USING (file,first_sheet) WHERE c=members GROUP BY 1,2),
nm AS (SELECT z.*, coalesce(shared,[]) AS shared, CASE WHEN list_contains(shared,'amount') OR (list_contains(shared,'quantity') AND list_contains(shared,'customer_id')) THEN 'sales'
  WHEN list_contains(shared,'customer') AND NOT list_contains(shared,'product') THEN 'customers' WHEN list_contains(shared,'product') THEN 'products'
  WHEN list_contains(shared,'vendor') THEN 'vendors' ELSE {O.snake('first_sheet')} END AS b FROM sizes z LEFT JOIN sh USING (file,first_sheet))
SELECT file, first_sheet, members, array_to_string(shared,'|') AS shared, members>1 AS is_union,
 CASE WHEN members>1 THEN 'share '||len(shared)||' canonical entities' ELSE 'distinct schema' END AS reason,
 b||CASE WHEN row_number() OVER (PARTITION BY file,b ORDER BY first_sheet)>1 THEN '_'||row_number() OVER (PARTITION BY file,b ORDER BY first_sheet) ELSE '' END AS table_name FROM nm""")
def name_groups(spark, d):
    g = G.name_groups(G.union_groups(M.entity_sets(matches(spark, d))))
    return g.select("file", "first_sheet", "members", F.array_join("shared", "|").alias("shared"), "is_union", "reason", "table_name")


CONFIRM_ROWS = """SELECT p_partkey AS pos, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN ' '||p_brand||' ' WHEN 2 THEN 'Item' ELSE '' END AS source,
 CASE p_partkey % 3 WHEN 0 THEN 'product' WHEN 1 THEN p_type ELSE 'package' END AS entity,
 CASE WHEN p_partkey % 5 = 0 THEN 'attribute' END AS role, cast(NULL AS {S}) AS type, cast(NULL AS {S}) AS expect FROM part"""


@query("confirm_aliases", O.with_(registry_values(), f"""conf AS ({CONFIRM_ROWS.replace('{S}','varchar')}),
usable AS (SELECT *, {O.norm('source')} AS form FROM conf WHERE source<>'' AND entity<>''),
fresh AS (SELECT entity, form, min(pos) AS pos, arg_min(lower(trim(source)),pos) AS alias FROM usable u WHERE form<>'' AND form<>{O.norm('entity')}
  AND NOT EXISTS (SELECT 1 FROM reg r WHERE r.entity=u.entity AND r.form=u.form AND r.form<>{O.norm('r.entity')}) GROUP BY 1,2),
names AS (SELECT entity FROM reg UNION SELECT entity FROM usable)""") + """SELECT n.entity AS name,
 coalesce((SELECT max(role) FROM reg r WHERE r.entity=n.entity), (SELECT arg_min(row(role),pos)[1] FROM usable u WHERE u.entity=n.entity), 'dimension') AS role,
 coalesce((SELECT max(type) FROM reg r WHERE r.entity=n.entity),'string') AS type, coalesce((SELECT string_agg(alias,'|' ORDER BY pos) FROM fresh f WHERE f.entity=n.entity),'') AS added FROM names n""")
def confirm_aliases(spark, d):
    register(spark, d)
    conf = spark.sql(CONFIRM_ROWS.replace("{S}", "string"))
    reg = E.registry_frame(spark)
    before = reg.select("name", F.size("aliases").alias("had"))
    out = E.confirm_aliases(reg, conf).join(before, "name", "left")
    added = F.slice("aliases", F.coalesce("had", F.lit(0)) + 1, F.greatest(F.size("aliases"), F.lit(1)))
    return out.select("name", "role", "type", F.array_join(added, "|").alias("added"))


@query("confirmed_order", O.with_(registry_values(), f"conf AS ({CONFIRM_ROWS.replace('{S}','varchar')})") + f"""SELECT entity AS name, {len(E.SEED) - 1} + row_number() OVER (ORDER BY min(pos), entity) AS place
 FROM conf WHERE source<>'' AND entity<>'' AND entity NOT IN (SELECT entity FROM reg) GROUP BY entity""")
def confirmed_order(spark, d):
    """Places of the new entities in the registry, after it was saved and read again."""
    register(spark, d)
    path = scratch_path(spark, "registry")
    E.write_registry(E.confirm_aliases(E.registry_frame(spark), spark.sql(CONFIRM_ROWS.replace("{S}", "string"))).drop("first_pos"), path)
    rows = [(e["name"], k) for k, e in enumerate(E.read_registry(spark, path)) if k >= len(E.SEED)]
    return spark.createDataFrame(rows, "name string, place bigint")


# --- conform -----------------------------------------------------------------------------------
SCHEMA_CTES = match_sql() + """,
pickc AS (SELECT sheet, min(row(col_index,source)) FILTER (WHERE lower(source)='date' OR (type='date' AND source ILIKE '%date%')) AS dc,
  min(row(col_index,source)) FILTER (WHERE lower(source)='time' OR type='time') AS tc FROM prof GROUP BY 1),
cmb AS (SELECT sheet, dc[2] AS ds, tc[2] AS ts FROM pickc WHERE dc[1]<>tc[1]),
sch AS (SELECT sheet, col_index, canonical AS name, ttype AS type, source, false AS stamped FROM prof p WHERE role<>'ignore'
  AND NOT EXISTS (SELECT 1 FROM cmb WHERE cmb.sheet=p.sheet AND p.source IN (ds,ts)) UNION ALL SELECT sheet,-1,'event_timestamp','timestamp',ds,true FROM cmb),
over_(sheet, source, entity) AS (VALUES ('Customers','Division','region')),
claims AS (SELECT s.*, CASE WHEN stamped THEN 'order_date' ELSE coalesce(o.entity,m.entity,s.name) END AS target,
  CASE WHEN stamped OR o.entity IS NOT NULL THEN 2.0 WHEN m.entity IS NOT NULL THEN m.confidence ELSE -1.0 END::double AS confidence
  FROM sch s LEFT JOIN over_ o ON o.sheet=s.sheet AND o.source=s.source LEFT JOIN matched m ON m.file='book.xlsx' AND m.sheet=s.sheet AND m.source=s.source),
given AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sheet,target ORDER BY confidence DESC, col_index)=1 THEN target ELSE name END AS g FROM claims),
cmap AS (SELECT sheet, name, type, source, target, confidence, col_index, g||CASE WHEN row_number() OVER (PARTITION BY sheet,g ORDER BY col_index)>1
  THEN '_'||row_number() OVER (PARTITION BY sheet,g ORDER BY col_index) ELSE '' END AS canonical FROM given)"""


def book_map(spark, d):
    profile = book_profile(spark, d)
    schema = R.generate_schema(profile)
    over = spark.createDataFrame([("book.xlsx", "Customers", "Division", "region")], "file string, sheet string, source string, entity string")
    return U.canonical_map(schema, matches(spark, d), over)


@query("canonical_map", O.with_(SCHEMA_CTES) + "SELECT sheet, name, target, confidence, canonical FROM cmap")
def canonical_map(spark, d):
    return book_map(spark, d).select("sheet", "name", "target", "confidence", "canonical")


# Canonical names of the messy schema, as the canonical map gives them for the monthly tabs.
MESSY_MAP = {
    "event_timestamp": ("order_date", "timestamp"), "customer_name": ("customer", "string"), "account_id": ("customer_id", "string"),
    "sku": ("product_code", "string"), "item": ("product", "string"), "qty": ("quantity", "decimal"), "net_sales": ("amount", "decimal"),
    "supplier": ("vendor", "string"), "state": ("region", "string"), "channel": ("channel", "string"),
}
CONFORMED = clean_sql() + f""",
conformed AS (SELECT pos, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, event_timestamp AS order_date, customer_name AS customer, account_id AS customer_id,
 sku AS product_code, item AS product, {O.number('qty','[,$]')} AS quantity, net_sales AS amount, supplier AS vendor, state AS region, channel FROM cleaned)"""
CONFORMED_COLUMNS = [c for c, _ in MESSY_MAP.values()]


def conformed_member(spark, d, name: str = "Sales", carried=()) -> U.Member:
    return U.conform(name, C.clean(messy_sheet(spark, d, name), RULES, SCHEMA).kept, MESSY_MAP, carried)


def conformed(spark, d):
    """Conformed sales rows with storage types and ``l_orderkey``."""
    rows, _ = U.union_members([conformed_member(spark, d, carried=["l_orderkey"])])
    return rows


@query("conform_sheet", O.with_(CONFORMED) + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, order_date, customer, customer_id, product_code, product, qty_text AS quantity, amount, vendor, region, channel FROM (SELECT c.*, qty_raw AS qty_text FROM conformed c JOIN casted k USING (pos))".replace("USING (pos)", "ON c.pos=k.pos"))
def conform_sheet(spark, d):
    return conformed_member(spark, d, carried=ORDER_KEY).rows.select(*ORDER_KEY, *CONFORMED_COLUMNS)


@query("union_members", O.with_(CONFORMED) + """, product_rows AS (SELECT lpad(p_partkey::varchar,8,'0') AS product_code, p_name AS product, p_retailprice AS unit_price, p_size::varchar AS unit_size FROM part)
SELECT 'Sales' AS member, product_code, product, quantity, amount, NULL::double AS unit_price, NULL::varchar AS unit_size, order_date FROM conformed
UNION ALL SELECT 'Products', product_code, product, NULL, NULL, unit_price, unit_size, NULL FROM product_rows""")
def union_members(spark, d):
    register(spark, d)
    part = spark.table("part").select(
        F.col("p_partkey").alias("pos"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("product_code"), F.col("p_name").alias("product"),
        F.col("p_retailprice").cast("string").alias("unit_price"), F.col("p_size").alias("unit_size"),
    )
    products = U.Member("Products", part, {"product_code": "string", "product": "string", "unit_price": "decimal", "unit_size": "string"})
    sales = conformed_member(spark, d)
    rows, _ = U.union_members([sales, products])
    return rows.select("member", "product_code", "product", "quantity", "amount", "unit_price", "unit_size", "order_date")


@query("check_registry", O.with_(SCHEMA_CTES) + """SELECT lower(sheet) AS table_name, true AS passed, count(*) FILTER (WHERE r) AS known_entities, count(*) FILTER (WHERE NOT r) AS new_entities,
 coalesce(string_agg(canonical,', ' ORDER BY canonical) FILTER (WHERE NOT r),'none') AS new, CASE WHEN bool_and(r) THEN 'fully covered' ELSE 'extends registry' END AS verdict
 FROM (SELECT *, canonical IN (SELECT entity FROM reg) AS r FROM cmap) GROUP BY 1""")
def check_registry(spark, d):
    columns = book_map(spark, d).select(F.lower("sheet").alias("table_name"), F.col("canonical").alias("column_name"))
    return U.check_registry(columns, E.registry_frame(spark))


DRIFT = SCHEMA_CTES + """,
now_ AS (SELECT DISTINCT CASE sheet WHEN 'Vendors' THEN 'customers' ELSE lower(sheet) END AS t, canonical AS c FROM cmap WHERE sheet<>'Customers'),
prev AS (SELECT DISTINCT lower(sheet) AS t, canonical AS c FROM cmap WHERE sheet<>'Sales' UNION SELECT 'products','shelf')"""


@query("check_drift", O.with_(DRIFT) + """, b AS (SELECT coalesce(n.t,p.t) AS t, coalesce(n.c,p.c) AS c, n.c IS NOT NULL AS is_now, p.c IS NOT NULL AS was FROM now_ n FULL JOIN prev p ON n.t=p.t AND n.c=p.c),
a AS (SELECT t, count(*) FILTER (WHERE was) AS nb, count(*) FILTER (WHERE is_now) AS nn, string_agg(c,', ' ORDER BY c) FILTER (WHERE NOT was) AS ad, string_agg(c,', ' ORDER BY c) FILTER (WHERE NOT is_now) AS rm FROM b GROUP BY 1)
SELECT t AS table_name, rm IS NULL AS passed, CASE WHEN nb=0 THEN 0 ELSE 1 END AS baseline_uploads, CASE WHEN nb=0 THEN 'none' ELSE coalesce(ad,'none') END AS added, coalesce(rm,'none') AS removed,
 CASE WHEN nb=0 THEN 'first upload' WHEN rm IS NOT NULL THEN 'breaking (columns removed)' WHEN ad IS NOT NULL THEN 'new columns added' ELSE 'stable' END AS drift FROM a WHERE nn>0""")
def check_drift(spark, d):
    columns = book_map(spark, d).select("sheet", F.lower("sheet").alias("table_name"), F.col("canonical").alias("column_name"))
    now = columns.filter(F.col("sheet") != "Customers").withColumn("table_name", F.when(F.col("sheet") == "Vendors", "customers").otherwise(F.col("table_name")))
    shelf = spark.range(0, 1, 1, 1).select(F.lit("products").alias("table_name"), F.lit("shelf").alias("column_name"))
    before = columns.filter(F.col("sheet") != "Sales").select("table_name", "column_name").unionByName(shelf)
    return U.check_drift(before, now)


# --- siblings ----------------------------------------------------------------------------------
def monthly_tabs(spark, d) -> dict[str, S.Tab]:
    """The messy rows as one cleaned tab per month; no row is dropped."""
    source = messy_sales(spark, d)
    tabs = {}
    for k in range(1, 13):
        titles = {c: tab_title(k, c) for c in MESSY_TITLES}
        schema = [{**c, "source": "QTY Ordered" if k % 2 and c["source"] == "Qty" else c["source"],
                   "name": "qty_ordered" if k % 2 and c["name"] == "qty" else c["name"]} for c in SCHEMA]
        sheet = C.Sheet.of_table(source.filter(F.col("month_no") == k), titles, name=TABS[k - 1])
        tabs[TABS[k - 1]] = S.Tab.of(TABS[k - 1], C.clean(sheet, C.keep_all_rows(RULES), schema).kept, schema)
    return tabs


def folded(spark, d):
    m = matches(spark, d).filter(F.col("file") == "tabs.xlsx")
    groups = G.union_groups(M.entity_sets(m), threshold=0.8)
    # Sheets of one workbook: a few names, titles and entities, needed to compile the selects.
    member_rows = groups.groupBy("group_id").agg(F.array_sort(F.collect_list("sheet")).alias("s")).collect()
    columns = m.select("sheet", "col_index", "source", "entity").orderBy("sheet", "col_index").collect()
    titles, entities, sources = {}, {}, {}
    for r in columns:
        titles.setdefault(r["sheet"], []).append(r["source"])
        entities.setdefault(r["sheet"], {})[r["source"]] = r["entity"]
        if r["entity"]:
            sources.setdefault(r["sheet"], {}).setdefault(r["entity"], r["source"])
    return S.fold_siblings(monthly_tabs(spark, d), [r["s"] for r in member_rows], ["Sales of 02"], titles, entities, sources)


@query("fold_siblings", O.with_(clean_sql()) + """SELECT customer_name_raw AS customer_name, sku_raw AS sku, qty_raw AS qty, round(sum(net_sales),2) AS net_sales, count(*) AS n,
 count(CASE WHEN month_no=2 THEN event_timestamp END) AS stamped FROM casted GROUP BY 1,2,3""")
def fold_siblings(spark, d):
    tabs, _ = folded(spark, d)
    rows = tabs["Sales of 02"].rows
    return rows.groupBy("customer_name", "sku", "qty").agg(
        F.round(F.sum("net_sales"), 2).alias("net_sales"), F.count(F.lit(1)).alias("n"), F.count("event_timestamp").alias("stamped")
    )
