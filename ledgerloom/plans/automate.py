"""Load a declared star from a workbook: clean every row, fold repeated tabs, create, load, check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators import declared as D, grouping as G, match as M, registry as E
from ledgerloom.operators.siblings import Tab, fold_siblings
from ledgerloom.plans.ingest import cleaned_sheets
from ledgerloom.plans.workbook import profile_workbook
from ledgerloom.session import durable
from ledgerloom.sources.staging import Store


@dataclass
class Automated:
    """diff: what the specification changes. tables: columns, keys and ``new`` of every table, before and after. folds: tabs folded into others. report: rows loaded. orphans: foreign keys without a parent."""

    diff: DataFrame
    tables: DataFrame
    folds: DataFrame | None
    report: DataFrame
    orphans: DataFrame


def referenced_sheets(spec: D.StarSpec) -> list[str]:
    """Sheets the facts read from, in order of first mention."""
    named = [D.source_sheet(c) for f in spec.facts() for c in spec.of(f["table"])]
    return list(dict.fromkeys(s for s in named if s))


def automate(
    rows: DataFrame, file: str, spec: D.StarSpec, store: Store, upload_id: str, registry: list[dict] | None = None,
    apply_filters: bool = False, dense: bool = True,
) -> Automated:
    """Run the whole flow for one file. No row is dropped unless ``apply_filters``."""
    registry = registry or E.read_registry(store.spark)
    book = profile_workbook(rows.filter(F.col("file") == file), dense=dense)
    matches = durable(M.match_columns(book.columns, registry), "matches")
    sheets = [r["sheet"] for r in book.sheets.filter(F.col("kind") == "data").select("sheet").orderBy("sheet").collect()]
    told, done = cleaned_sheets(book, [(0, n, file, s, None) for n, s in enumerate(sheets)], keep_all=not apply_filters)
    by_plan = {c.plan.signature: c for c in done}
    shared = {k: c.kept() for k, c in by_plan.items()}
    tabs = {}
    for r in told.select("sheet", "member_no", "signature").orderBy("member_no").collect():  # sheets of one file
        plan = by_plan[r["signature"]].plan
        tabs[r["sheet"]] = Tab.of_shared(r["sheet"], shared[r["signature"]], r["member_no"], plan.schema)
    groups = G.union_groups(M.entity_sets(matches), threshold=0.8)
    members = groups.groupBy("group_id").agg(F.array_sort(F.collect_list("sheet")).alias("s")).collect()  # sheet names of one file
    titles: dict[str, list[str]] = {}
    entities: dict[str, dict[str, str]] = {}
    sources: dict[str, dict[str, str]] = {}
    for r in matches.select("sheet", "col_index", "source", "entity").orderBy("sheet", "col_index").collect():
        titles.setdefault(r["sheet"], []).append(r["source"])
        entities.setdefault(r["sheet"], {})[r["source"]] = r["entity"]
        if r["entity"]:
            sources.setdefault(r["sheet"], {}).setdefault(r["entity"], r["source"])
    tabs, folds = fold_siblings(tabs, [r["s"] for r in members], referenced_sheets(spec), titles, entities, sources)
    diff = durable(D.star_diff(store, spec), "star-diff")
    before = D.table_list(store, spec)
    D.ensure_tables(store, spec)
    report = D.load(store, spec, tabs, upload_id)
    return Automated(diff, D.listed_tables(store.spark, before, D.table_list(store, spec)), folds, report, D.fk_orphans(store, spec))
