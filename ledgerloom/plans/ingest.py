"""Ingest: profile, clean, conform, check, stage, and rebuild the star.

Rules are data here (:mod:`ledgerloom.plans.signature`): sheets with the same plan share one job, and each table is
staged by one job more, so the number of jobs follows the plans and tables, not the sheets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ledgerloom.functions.casts import coerce, storage_type
from ledgerloom.operators import conform as U, match as M, registry as E, star as W
from ledgerloom.plans import signature as S
from ledgerloom.plans.mastering import MasterState, rebuild_star
from ledgerloom.plans.workbook import Workbook, profile_workbook
from ledgerloom.session import durable
from ledgerloom.sources import runlog
from ledgerloom.sources.staging import Staging


@dataclass
class Summary:
    """What one run did; ``members`` and ``tables`` are small, the other frames are lazy reports over the cleaned rows.

    members: table_name, member_no, sheet, input_count, kept_count, dropped_count.
    tables: table_name, row_count, columns (name and type in order), added_columns, known_entities, new_entities, new,
    verdict, baseline_uploads, added, removed, drift, sheets.
    dropped: table_name, sheet, pos, reason, sample. dq: table_name, sheet, name, type, null_pct, distinct.
    """

    members: DataFrame
    tables: DataFrame
    dropped: DataFrame
    dq: DataFrame


@dataclass
class Ingested:
    summary: Summary
    checks: DataFrame
    star: W.Star | None
    run_id: str


def cleaned_sheets(
    book: Workbook, wanted: list[tuple[int, int, str, str, list[dict] | None]], mapping: DataFrame | None = None, keep_all: bool = False
) -> tuple[DataFrame, list[S.Cleaned]]:
    """The requested sheets that hold data, cleaned plan by plan."""
    told = S.signed(book, S.requests(book, wanted), mapping, keep_all)
    return told, [S.clean_plan(book, told, p, keep_all) for p in S.plans(told)]


def union_types(done: list[S.Cleaned], table: int) -> dict[str, str]:
    """Columns of a table in first-seen order of its members, with their first-seen type."""
    out: dict[str, str] = {}
    for c in sorted((c for c in done if table in c.plan.first_member), key=lambda c: c.plan.first_member[table]):
        for own, (name, kind) in c.plan.names.items():
            if own in c.columns:
                out.setdefault(name, kind)
    return out


def starts(counts: DataFrame) -> DataFrame:
    """Where the rows of each member start in its table: the sum of the last row numbers of the members before."""
    before = Window.partitionBy("table_no").orderBy("member_no").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.coalesce("last_row", F.lit(0)) + 1).over(before), F.lit(0)).cast("long")
    return durable(counts.select(F.col("table_no").alias("_table_no"), F.col("member_no").alias("_member_no"), base.alias("_start")), "starts")


def table_rows(done: list[S.Cleaned], table: int, types: dict[str, str], begin: DataFrame) -> DataFrame | None:
    """Kept rows of all members under canonical names and types, with ``pos``; missing columns are NULL."""
    out = None
    for c in done:
        if table not in c.plan.first_member:
            continue
        have = {f.name: f.dataType for f in c.rows.schema.fields}
        own = {c.plan.names[n][0]: n for n in c.columns if n in c.plan.names}
        values = [(coerce(F.col(own[n]), t, have[own[n]]) if n in own else F.lit(None).cast(storage_type(t))).alias(n) for n, t in types.items()]
        numeric = isinstance(have["_pos"], T.IntegralType)
        kept = c.kept().filter(F.col("_table_no") == table)
        if numeric:
            kept = kept.join(begin, ["_table_no", "_member_no"])
        pos = F.col("_start") + F.col("_pos") if numeric else F.struct("_member_no", "_pos")
        part = kept.select(pos.alias("pos"), *values)
        out = part if out is None else out.unionByName(part)
    return out


def summarise(staging: Staging, tables: list[dict], told: DataFrame, done: list[S.Cleaned], counts: DataFrame, stored: list[dict], before: dict[int, list[str]], registry: list[dict]) -> tuple[Summary, DataFrame]:
    """The summary of a run and its checks (table_name, check_name, passed, details)."""
    spark = staging.spark
    named = F.element_at(F.array(*[F.lit(t["table"]) for t in tables]), F.col("table_no") + 1).alias("table_name")
    now = spark.createDataFrame([(s["name"], c) for s in stored for c in s["types"]], "table_name string, column_name string")
    old = spark.createDataFrame([(s["name"], c) for s in stored for c in before[s["no"]]], "table_name string, column_name string")
    covered, drift = U.check_registry(now, E.registry_frame(spark, registry)), U.check_drift(old, now)
    done_tables = spark.createDataFrame(
        [(s["name"], s["rows"], list(s["types"].items()), ", ".join(s["added"]) or "none") for s in stored],
        "table_name string, row_count long, columns array<struct<name string, type string>>, added_columns string",
    )
    # the names of a table's sheets, in order of its members
    listed = F.transform(F.array_sort(F.collect_list(F.struct("member_no", "sheet"))), lambda m: m["sheet"])
    sheets = told.groupBy("table_no").agg(F.array_join(listed, ", ").alias("sheets")).select(named, "sheets")
    table_info = durable(
        done_tables.join(covered.drop("passed"), "table_name").join(drift.drop("passed"), "table_name").join(sheets, "table_name").select(*done_tables.columns, "sheets", "known_entities", "new_entities", "new", "verdict", "baseline_uploads", "added", "removed", "drift"),
        "tables",
    )
    told_checks = covered.select("table_name", F.lit("schema_vs_registry").alias("check_name"), "passed", F.col("verdict").alias("details"))
    checks = durable(told_checks.unionByName(drift.select("table_name", F.lit("schema_drift").alias("check_name"), "passed", F.col("drift").alias("details"))), "checks")
    summary = Summary(
        counts.select(named, "member_no", "sheet", "input_count", "kept_count", "dropped_count"),
        table_info,
        S.dropped_rows(told, done).select(named, "sheet", "pos", "reason", "sample"),
        S.member_dq(told, done).select(named, "sheet", "name", "type", "null_pct", "distinct"),
    )
    return summary, checks


def ingest(
    rows: DataFrame,
    tables: list[dict],
    staging: Staging,
    upload_id: str,
    registry: list[dict] | None = None,
    rebuild: bool = True,
    dense: bool = True,
) -> Ingested:
    """Ingest the sheets of one upload.

    ``tables`` = ``[{table, file, members: [sheet], overrides: {title: entity}, rules: {sheet: [rule]}}]``.
    Sheets that do not exist or hold no data are skipped. The run is logged, whatever its outcome.
    """
    spark = staging.spark
    run_id, status = uuid.uuid4().hex, "FAILURE"
    try:
        registry = registry or E.read_registry(spark)
        book = profile_workbook(rows, dense=dense)
        matches = durable(M.match_columns(book.columns, registry), "matches")
        confirmed = {(t["file"], s, k): e for t in tables for s in t["members"] for k, e in (t.get("overrides") or {}).items()}
        overrides = durable(spark.createDataFrame([(*k, e) for k, e in confirmed.items()], "file string, sheet string, source string, entity string"), "overrides")
        mapping = durable(U.canonical_map(book.schema, matches, overrides), "mapping")
        wanted = [(n, m, t["file"], s, (t.get("rules") or {}).get(s)) for n, t in enumerate(tables) for m, s in enumerate(t["members"])]
        told, done = cleaned_sheets(book, wanted, mapping)
        counts = durable(S.member_counts(told, done), "members")
        begin = starts(counts)
        stored, before = [], {}
        for n, t in enumerate(tables):
            types = union_types(done, n)
            found = table_rows(done, n, types, begin)
            if found is None:
                continue
            before[n] = list(staging.columns(t["table"]))
            written = staging.write(t["table"], found, types, upload_id)
            stored.append({"no": n, "name": t["table"], "types": types, "rows": written["rows"], "added": written["added_columns"], "asset": written["table"]})
        runlog.append(spark, staging.root, "materialized", [(run_id, s["asset"], s["rows"], ", ".join(s["added"]) or "none") for s in stored], runlog.MATERIALIZED)
        summary, checks = summarise(staging, tables, told, done, counts, stored, before, registry)
        checks.select(F.lit(run_id).alias("run_id"), F.col("table_name").alias("asset"), "check_name", "passed", "details").write.mode("append").parquet(f"{staging.root}/log/check_log")
        star = None
        if rebuild:
            for t in stored:
                MasterState(staging).update(t["name"], upload_id)
            star = rebuild_star(staging)
        status = "SUCCESS"
        return Ingested(summary, checks, star, run_id)
    finally:
        runlog.append(spark, staging.root, "run_log", [(run_id, status, "ingest", upload_id, datetime.now(timezone.utc))], runlog.RUN)
