"""Layout, profiling, roles, rules, cleaning and matching on small sheets."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import clean as C, conform as U, headers as H, match as M, profile as P, registry as E
from ledgerloom.operators.firstk import first_k
from ledgerloom.plans.workbook import profile_workbook

CELL = "array<struct<kind:string,text:string>>"


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("bool", str(v))
    return ({int: "int", float: "float"}.get(type(v), "str"), str(v))


def sheet_rows(spark, sheets):
    rows = [("f.xlsx", s, i, [cell(v) for v in r]) for s, grid in sheets.items() for i, r in enumerate(grid)]
    return spark.createDataFrame(rows, f"file string, sheet string, row_no bigint, cells {CELL}")


def column_profile(spark, titles, rows):
    book = sheet_rows(spark, {"S": [titles, *rows]})
    sheets = H.classify_sheets(book)
    cells = H.melt_cells(H.data_rows(book, sheets.withColumn("kind", F.lit("data"))))
    got = P.profile_columns(cells, H.sheet_columns(sheets.withColumn("kind", F.lit("data"))))
    return {r["source"]: r.asDict() for r in got.collect()}


def test_types_and_roles(spark):
    p = column_profile(
        spark, ["Flag", "Answer", "N", "Name", "Code", "When", "At", "Price"],
        [["True", "Yes", 1, "Cook", "00006862", "2025-10-01", "9:30", "$1,000.50"], ["False", "No", 2, "Lavallette Liquors", "00007103", "10/2/2025", "10:15", "$2.00"],
         ["True", "Yes", 3, "Bottle Shop", "00007104", "10/3/25", "11:00 pm", "$3.00"]],
    )
    assert [p[c]["type"] for c in ("Flag", "Answer", "N", "Name", "When", "At", "Price")] == ["boolean", "boolean", "number", "string", "date", "time", "currency"]
    assert p["Name"]["role"] == "dimension" and p["Code"]["role"] == "id" and p["Code"]["ttype"] == "string"
    assert p["N"]["sample"] == ["1", "2", "3"] and (p["N"]["min"], p["N"]["max"]) == (1.0, 3.0)
    assert p["Price"]["max"] == 1000.5 and p["N"]["ttype"] == "integer"


@pytest.mark.parametrize("n, role", [(1, "dimension"), (50, "ignore")])
def test_constant_column_needs_rows(spark, n, role):
    p = column_profile(spark, ["Status", "Other", "Third"], [["open", f"o{i}", f"t{i}"] for i in range(n)])
    assert p["Status"]["role"] == role


def test_layout(spark):
    grid = {
        "Data": [["Report"], [None], ["Name", "Qty", None, "Qty"], ["a", 1, 2.5, "x"], [None, None], ["b", 2], ["c", 3, 1.5, "y"], [None], [" "]],
        "Cover": [["Title", "x"], ["Owner", "y"]],
        "Notes": [["A", "B", "C"], ["1", "2", "3"], ["4", "5", "6"]],
    }
    book = H.trim_trailing_blank(sheet_rows(spark, grid))
    sheets = {r["sheet"]: r for r in H.classify_sheets(book).collect()}
    assert (sheets["Data"]["kind"], sheets["Data"]["header_row"], sheets["Data"]["data_rows"]) == ("data", 2, 4)
    assert sheets["Cover"]["kind"] == "metadata" and sheets["Notes"]["kind"] == "metadata"
    titles = [r["source"] for r in H.sheet_columns(H.classify_sheets(book)).orderBy("col_index").collect()]
    assert titles == ["Name", "Qty", "column_3", "Qty"]
    body = H.data_rows(book, H.classify_sheets(book))
    assert body.count() == 3 and {len(r["cells"]) for r in body.collect()} == {4}


def test_workbook_flow(spark):
    rows = [["Date", "Time", "Customer Name", "Qty", "Net Sales"]]
    rows += [[f"10/{i % 28 + 1}/2025", f"{i % 12}:15", "Employee_Matt" if i % 10 == 0 else (None if i % 9 == 1 else f"Bar {i % 7}"), i % 5, f"${i},000.00"] for i in range(40)]
    book = profile_workbook(sheet_rows(spark, {"Sales": rows}))
    kinds = [(r["kind"], r["enabled"]) for r in book.rules.orderBy("seq").collect()]
    assert kinds == [("select_sheet", True), ("cast", True), ("cast", True), ("combine_datetime", True), ("filter", True), ("filter", False), ("filter", True), ("dedupe", False)]
    schema = C.schema_dicts(book.schema, "f.xlsx", "Sales")
    assert schema[0]["name"] == "event_timestamp" and [c["name"] for c in schema[1:]] == ["customer_name", "qty", "net_sales"]
    sheet = C.Sheet.of_cells(book.data_rows, "f.xlsx", "Sales", C.sheet_titles(book.titles, "f.xlsx", "Sales"))
    done = C.clean(sheet, C.rule_dicts(book.rules, "f.xlsx", "Sales"), schema)
    n = done.counts().first()
    assert n["input_count"] == 40 and n["kept_count"] + n["dropped_count"] == 40 and n["dropped_count"] == 8
    first = done.kept.orderBy("pos").first()
    assert first["event_timestamp"] == "2025-10-03T02:15:00" and first["net_sales"] == 2000.0


def test_dedupe_keeps_first_and_counts(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", 1) for i in range(30)], "pos bigint, x string, y int")
    sheet = C.Sheet.of_table(df, {"x": "X", "y": "Y"})
    schema = [{"name": "x", "type": "string", "source": "X", "include": True}]
    done = C.clean(sheet, [{"kind": "dedupe", "enabled": True, "title": "", "spec": {}}], schema)
    assert sorted((r["pos"], r["x"]) for r in done.kept.collect()) == [(0, "b"), (1, "a")]
    assert done.dropped.count() == 28
    assert [r["pos"] for r in C.dropped_report(done, 2).collect()] == [2, 3]


def test_repeated_titles_last_wins(spark):
    df = spark.createDataFrame([(1, "left", "right")], "pos bigint, a string, b string")
    sheet = C.Sheet(df.select("pos", F.col("a").alias("c0"), F.col("b").alias("c1")), ["Name", "Name"])
    kept = C.clean(sheet, [], [{"name": "name", "type": "string", "source": "Name", "include": True}]).kept
    assert kept.first()["name"] == "right"


def test_first_k_equals_full_sort(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.hash("id").alias("o"), "id").dropDuplicates(["o"])
    got = {(r["g"], r["o"]) for r in first_k(df, ["g"], "o", 7).collect()}
    want = set()
    for g in range(3):
        want |= {(g, r["o"]) for r in df.filter(F.col("g") == g).orderBy("o").limit(7).collect()}
    assert got == want


TITLES = [
    ("CustName", "string", False, "customer", 0.99), ("Account ID", "number", True, "customer_id", 0.99), ("SKU", "string", True, "product_code", 0.99),
    ("QTY Ordered", "number", False, "quantity", 0.99), ("Unit", "string", False, "quantity", 0.6456), ("Net Sales", "number", False, "amount", 0.99),
    ("Show Cust Detail", "boolean", False, None, None), ("Unit Size", "string", False, None, None), ("c_name", "string", False, "customer", 0.8327),
    ("l_quantity", "number", False, "quantity", 0.9222), ("o_orderdate", "date", False, "order_date", 0.6842), ("s_name", "string", False, "vendor", 0.7148),
]


def test_title_matches(spark):
    rows = [("f", "s", i, t, ty, strong, False, "id" if strong else "dimension") for i, (t, ty, strong, _, _) in enumerate(TITLES)]
    profile = spark.createDataFrame(rows, "file string, sheet string, col_index int, source string, type string, leading_zero boolean, big_int boolean, role string")
    got = {r["source"]: r for r in M.match_columns(profile, E.SEED).collect()}
    for title, _, _, entity, score in TITLES:
        assert got[title]["entity"] == entity, title
        if score:
            assert got[title]["confidence"] == score
        assert len(got[title]["alternatives"]) == 3 and got[title]["suggest_new"] == (entity is None)


def test_collisions_go_to_the_surer_column(spark):
    profile = spark.createDataFrame(
        [("f", "s", 0, "Qty", "number", False, False, "measure", "qty"), ("f", "s", 1, "Unit", "string", False, False, "dimension", "unit")],
        "file string, sheet string, col_index int, source string, type string, leading_zero boolean, big_int boolean, role string, canonical string",
    )
    schema = spark.createDataFrame(
        [("f", "s", 1, "qty", "decimal", "Qty", None), ("f", "s", 2, "unit", "string", "Unit", None)],
        "file string, sheet string, position int, name string, type string, source string, time_source string",
    )
    got = {r["name"]: r["canonical"] for r in U.canonical_map(schema, M.match_columns(profile, E.SEED)).collect()}
    assert got == {"qty": "quantity", "unit": "unit"}
