"""Fold tabs that repeat one schema (monthly exports) into the tab a fact refers to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerloom.functions.text import text_of


def plain_snake(title: str) -> str:
    """Snake case of one title of a specification (the column form is ``functions.text.snake``)."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in title.lower()).split()
    name = "_".join(words)
    if name[:1].isdigit():
        name = "col_" + name
    return name or "column"


@dataclass
class Tab:
    """Cleaned rows of one sheet. ``keys`` maps every name a column answers to onto the column.

    Tabs cleaned together share ``shared``, whose ``_member_no`` tells them apart by ``number``.
    """

    name: str
    rows: DataFrame
    keys: dict[str, str]
    shared: DataFrame | None = None
    number: int = 0

    @classmethod
    def of_shared(cls, name: str, shared: DataFrame, number: int, schema: list[dict]) -> Tab:
        own = [c for c in shared.columns if not c.startswith("_")]
        rows = shared.filter(F.col("_member_no") == number).select(F.col("_pos").alias("pos"), *own)
        tab = cls.of(name, rows, schema)
        return cls(name, rows, tab.keys, shared, number)

    @classmethod
    def of(cls, name: str, kept: DataFrame, schema: list[dict]) -> Tab:
        keys: dict[str, str] = {}
        for c in schema:
            if c.get("include", True):
                if not c.get("time_source"):
                    keys[c["source"]] = c["name"]
                keys[c["name"]] = c["name"]
        return cls(name, kept, keys)

    def column(self, key: str) -> Column:
        return F.col(self.keys[key]) if key in self.keys else F.lit(None).cast("string")


def _aligned(sibling: Tab, target_titles: list[str], target_entities: dict[str, str], sibling_sources: dict[str, str]) -> dict[str, str]:
    """Target column -> sibling column: same title, else same snake name, else same entity."""
    out: dict[str, str] = {}
    for title in target_titles:
        by_entity = sibling_sources.get(target_entities.get(title) or "")
        for key in (title, plain_snake(title), by_entity):
            if key is not None and key in sibling.keys:
                out[plain_snake(title)] = sibling.keys[key]
                break
    return out


def fold_siblings(
    tabs: dict[str, Tab],
    groups: list[list[str]],
    referenced: list[str],
    titles: dict[str, list[str]],
    entities: dict[str, dict[str, str]],
    sources: dict[str, dict[str, str]],
) -> tuple[dict[str, Tab], DataFrame | None]:
    """Append the rows of each group's other tabs to the tab a fact refers to.

    ``titles[sheet]`` are its column titles, ``entities[sheet]`` title -> entity, ``sources[sheet]``
    entity -> first title. Returns the tabs without the folded ones and, per fold, the rows added.
    """
    left = dict(tabs)
    reports = []
    for group in groups:
        members = [m for m in group if m in tabs]
        target = next((m for m in referenced if m in members), None)
        if len(members) < 2 or target is None or target not in titles:
            continue
        base = tabs[target]
        keys = dict(base.keys)
        types = {f.name: f.dataType for f in base.rows.schema.fields}
        for title in titles[target]:
            keys.setdefault(title, plain_snake(title))
            keys.setdefault(plain_snake(title), plain_snake(title))
        lost = [m for m in members if m != target]
        # tabs cleaned together that give the same columns are one branch, however many they are
        branches: dict[tuple, list[str]] = {}
        for m in lost:
            picks = _aligned(tabs[m], titles[target], entities.get(target, {}), sources.get(m, {}))
            if picks:
                shared = tabs[m].shared
                branches.setdefault((m if shared is None else id(shared), tuple(picks.items())), []).append(m)
        numeric = all(isinstance(t.rows.schema["pos"].dataType, T.IntegralType) for t in (base, *(tabs[n[0]] for n in branches.values())))

        def placed(number: Column, pos: Column) -> Column:
            """A row's place in the folded tab; equal places in two tabs stay apart."""
            return (number.cast("long") * F.lit(1 << 40) + pos if numeric else F.struct(number.cast("long").alias("tab_no"), pos.alias("pos"))).alias("pos")

        parts = [base.rows.withColumn("tab", F.lit(False)).withColumn("pos", placed(F.lit(0), F.col("pos")))]
        for (_, picked), group in branches.items():
            first = tabs[group[0]]
            have = {f.name: f.dataType for f in first.rows.schema.fields}

            def fitted(name: str, column: str) -> Column:
                want = types.get(name, have[column])
                c = F.col(column)
                return (c if want == have[column] else text_of(c, have[column]).try_cast(want)).alias(name)

            if first.shared is None:
                rows, place = first.rows, placed(F.lit(1 + lost.index(group[0])), F.col("pos"))
            else:
                rows = first.shared.filter(F.col("_member_no").isin([tabs[m].number for m in group]))
                place = placed(F.lit(1) + F.col("_member_no"), F.col("_pos"))
            part = rows.select(place, *[fitted(n, c) for n, c in picked], F.lit(True).alias("tab"))
            parts.append(part.filter(F.coalesce(*[F.col(n).cast("string") for n, _ in picked]).isNotNull()))
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p, allowMissingColumns=True)
        for m in lost:
            left.pop(m)
        left[target] = Tab(target, merged.drop("tab"), {k: c for k, c in keys.items() if c in merged.columns})
        reports.append(
            merged.groupBy().agg(
                F.lit(target).alias("unioned_into"), F.lit(", ".join(lost)).alias("folded_tabs"),
                F.count_if("tab").alias("rows_added"),
            )
        )
    report = None
    for r in reports:
        report = r if report is None else report.unionByName(r)
    return left, report


__all__ = ["Tab", "fold_siblings", "plain_snake"]
