"""Whole flows: plan signatures, summaries, folded tabs, and the number of jobs."""

import pytest
from tests.test_sheets import sheet_rows

from ledgerloom.operators import declared as D, siblings as S
from ledgerloom.plans.automate import automate
from ledgerloom.plans.ingest import ingest
from ledgerloom.plans.workbook import profile_workbook
from ledgerloom.sources import runlog
from ledgerloom.sources.staging import Staging, Store

TITLES = ["Date", "Time", "Customer Name", "Account ID", "Qty", "Net Sales"]


def month(k, n=24):
    rows = [[f"10/{i % 28 + 1}/2025", f"{i % 12}:15", "Employee_Matt" if i % 10 == 0 else (None if i % 9 == 1 else f"Bar {(i + k) % 7}"), f"{k:04d}{i:04d}", i % 5, f"${i},000.00"] for i in range(n)]
    return [TITLES, *rows]


def months(n):
    return {f"M{k:03d}": month(k) for k in range(n)}


def run(spark, tmp_path, n, rebuild=False):
    rows = sheet_rows(spark, months(n)).repartition(4)
    staging = Staging(spark, str(tmp_path / f"w{n}"))
    tables = [{"table": "sales", "file": "f.xlsx", "members": [*months(n), "Nowhere"]}]
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = count()
    done = ingest(rows, tables, staging, "u1", rebuild=rebuild)
    return done, staging, count() - before


def test_as_many_jobs_for_many_sheets_as_for_two(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few, _, jobs = run(spark, tmp_path, 2)
        many, staging, more = run(spark, tmp_path, 60)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # which small side is sent around may differ
    assert abs(more - jobs) <= 2
    assert staging.read("sales").count() == few.summary.tables.first()["row_count"] * 30 == 60 * 19


def test_summary_tells_members_rows_reasons_and_quality(spark, tmp_path):
    done, staging, _ = run(spark, tmp_path, 3, True)
    members = {r["sheet"]: r for r in done.summary.members.collect()}
    assert {(s, r["input_count"], r["kept_count"], r["dropped_count"]) for s, r in members.items()} == {(s, 24, 19, 5) for s in months(3)}
    table = done.summary.tables.first()
    assert (table["row_count"], table["drift"], table["added_columns"], table["baseline_uploads"]) == (57, "first upload", ", ".join(c["name"] for c in table["columns"]), 0)
    assert [(c["name"], c["type"]) for c in table["columns"]][:2] == [("order_date", "timestamp"), ("customer", "string")]
    dropped = done.summary.dropped.collect()
    assert len(dropped) == 15 and {r["reason"][:9] for r in dropped} == {"Leave out"} and all(r["sample"] for r in dropped)
    dq = {(r["sheet"], r["name"]): (r["null_pct"], r["distinct"]) for r in done.summary.dq.collect()}
    assert dq["M001", "account_id"] == (0.0, 19) and dq["M001", "qty"] == (0.0, 5)
    # every row of every member, in member order
    stored = [r["customer_id"] for r in staging.read("sales").orderBy("_row").collect()]
    assert stored == sorted(stored) and len(set(stored)) == 57
    assert done.star.fact_sales.count() == 57
    assert {r["check_name"] for r in done.checks.collect()} == {"schema_vs_registry", "schema_drift"}


def test_rules_of_the_caller_and_a_failure_are_seen(spark, tmp_path):
    rows, staging = sheet_rows(spark, {**months(2), "Other": [["Name", "Code", "Qty"], ["a", "x1", 1], ["a", "x1", 1], ["b", "x2", 2]]}), Staging(spark, str(tmp_path / "w"))
    given = {"Other": [{"kind": "dedupe", "enabled": True, "title": "", "spec": {}}]}
    done = ingest(rows, [{"table": "sales", "file": "f.xlsx", "members": ["M000", "M001"]}, {"table": "other", "file": "f.xlsx", "members": ["Other"], "rules": given}], staging, "u1", rebuild=False)
    got = {r["sheet"]: (r["input_count"], r["kept_count"]) for r in done.summary.members.collect()}
    assert got == {"M000": (24, 19), "M001": (24, 19), "Other": (3, 2)}
    assert [(r["sheet"], r["pos"]) for r in done.summary.dropped.filter("table_name = 'other'").collect()] == [("Other", 2)]
    # no rows of an upload are left when it comes again empty
    assert staging.write("other", staging.read("other").selectExpr("_row AS pos", "*").limit(0), {"quantity": "integer"}, "u1")["rows"] == 0
    assert staging.read("other").count() == 0
    with pytest.raises(Exception):
        ingest(rows.drop("cells"), [], staging, "u2")
    assert [(r["status"], r["partition"]) for r in runlog.run_history(spark, staging.root).collect()] == [("FAILURE", "u2"), ("SUCCESS", "u1")]


def column(table, name, type_, role, source="", references=""):
    return {"table": table, "name": name, "type": type_, "role": role, "source": source, "references": references}


SPEC = D.StarSpec(
    [{"table": "dim_client", "kind": "dimension", "natural_key": ["client"]}, {"table": "fact_lines", "kind": "fact", "natural_key": []}],
    [column("dim_client", "client_key", "integer", "pk"), column("dim_client", "client", "text", "attribute", "M000.Customer Name"),
     column("fact_lines", "line_key", "integer", "pk"), column("fact_lines", "client_key", "integer", "fk", "", "dim_client.client_key"), column("fact_lines", "qty", "integer", "measure", "M000.Qty")],
)


def test_automate_folds_monthly_tabs_in_one_branch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "ai_")
    done = automate(sheet_rows(spark, months(12)).repartition(4), "f.xlsx", SPEC, store, "u1")
    assert {(r["table_name"], r["row_count"]) for r in done.report.collect()} == {("dim_client", 8), ("fact_lines", 12 * 24)}
    fold = done.folds.first()
    assert (fold["unioned_into"], fold["rows_added"]) == ("M000", 11 * 24) and fold["folded_tabs"] == ", ".join(f"M{k:03d}" for k in range(1, 12))
    facts = D.read_declared(store, "fact_lines")
    assert facts.select("line_key").distinct().count() == 12 * 24
    assert {(r["object"], r["action"]) for r in done.diff.collect()} == {("dim_client", "created"), ("fact_lines", "created"), ("fact_lines.client_key -> dim_client.client_key", "foreign_key")}
    after = {r["table_name"]: r for r in done.tables.collect()}
    assert after["fact_lines"]["new"] and after["fact_lines"]["primary_key"] == ["line_key"] and after["fact_lines"]["foreign_keys"] == ["client_key -> dim_client.client_key"]
    assert {r["orphans"] for r in done.orphans.collect()} == {0}
    again = automate(sheet_rows(spark, months(2)), "f.xlsx", SPEC, store, "u2")
    assert {(r["phase"], r["table_name"], r["new"]) for r in again.tables.collect()} == {(p, t, False) for p in ("before", "after") for t in ("dim_client", "fact_lines")}


def test_one_branch_for_tabs_cleaned_together(spark):
    book = profile_workbook(sheet_rows(spark, months(4)))
    from ledgerloom.plans.ingest import cleaned_sheets

    told, done = cleaned_sheets(book, [(0, n, "f.xlsx", s, None) for n, s in enumerate(months(4))], keep_all=True)
    assert len(done) == 1 and done[0].seen["rows"] == 96 and done[0].seen["dropped"] == 0
    shared = done[0].kept()
    tabs = {s: S.Tab.of_shared(s, shared, n, done[0].plan.schema) for n, s in enumerate(months(4))}
    left, _ = S.fold_siblings(tabs, [list(tabs)], ["M000"], {s: TITLES for s in tabs}, {}, {})
    assert list(left) == ["M000"] and left["M000"].rows.select("pos").distinct().count() == 96
    assert left["M000"].rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
