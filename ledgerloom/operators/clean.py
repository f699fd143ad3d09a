"""Cleaning: rules and schema of one sheet compiled into column expressions.

Phases always run in the same order, whatever the order of the rules: combine, cast, filter, dedupe,
project, statistics. A sheet travels with positional columns ``c0..cn``, because titles may repeat
or differ only in case; the titles come back at projection.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerloom.functions import casts
from ledgerloom.functions.text import is_blank, text_of
from ledgerloom.operators.headers import SHEET

DUPLICATE = "Exact duplicate"


@dataclass
class Value:
    """A column with what is known about its type: a static Spark type, or a kind per cell."""

    col: Column
    dtype: T.DataType = field(default_factory=T.StringType)
    kind: Column | None = None

    @property
    def text(self) -> Column:
        return text_of(self.col, self.dtype)

    def number_text(self) -> Column:
        """Identifier form: whole floats without `.0`."""
        if self.kind is None:
            return casts.cast_text(self.col, self.dtype)
        return F.when(self.kind == "float", F.coalesce(casts.cast_text(self.col.try_cast("double"), T.DoubleType()), self.col)).otherwise(self.col)

    def iso_date(self) -> Column:
        if self.kind is None:
            return casts.iso_date(self.col, self.dtype)
        return F.when(self.kind.isin("date", "datetime"), self.col.substr(1, 10)).otherwise(casts.iso_date(self.col))

    def time_of_day(self, ampm: bool) -> Column:
        if self.kind is None:
            return casts.time_of_day(self.col, self.dtype, ampm)
        number = self.kind.isin("int", "float")
        fraction = casts.time_of_day(F.when(number, self.col.try_cast("double")), T.DoubleType())
        return F.when(number, fraction).otherwise(casts.time_of_day(self.col, ampm=ampm))

    def shown(self) -> Column:
        """Value as projected: dates and times in ISO form, everything else unchanged."""
        if self.kind is not None:
            return F.when(self.kind == "datetime", F.regexp_replace(self.col, " ", "T")).otherwise(self.col)
        if isinstance(self.dtype, T.DateType):
            return self.col.cast("string")
        if isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType)):
            return F.regexp_replace(self.text, " ", "T")
        return self.col


@dataclass
class Sheet:
    """Rows of one sheet: ``pos`` (unique order key), ``c0..cn`` and, for untyped cells, ``k0..kn``.

    Sheets with the same titles can be cleaned together: ``keys`` are the columns that tell their rows apart, and
    ``pos`` is unique among rows with equal keys. Such columns have no null.
    ``carried`` are columns that follow their rows into ``kept`` and ``dropped`` and have no part in any rule; none may
    have the name of a projected column.
    """

    rows: DataFrame
    titles: list[str]
    name: str = "Sheet1"
    keys: tuple[str, ...] = ()
    carried: tuple[str, ...] = ()

    @classmethod
    def of_table(cls, df: DataFrame, titles: dict[str, str], pos: str = "pos", name: str = "Sheet1", carried: Iterable[str] = ()) -> Sheet:
        """A typed table whose column ``key`` is titled ``titles[key]``."""
        picked = [F.col(c).alias(f"c{i}") for i, c in enumerate(titles)]
        return cls(df.select(F.col(pos).alias("pos"), *carried, *picked), list(titles.values()), name, carried=tuple(carried))

    @classmethod
    def of_cells(cls, data_rows: DataFrame, file: str, sheet: str, titles: list[str]) -> Sheet:
        """One sheet of the long row form produced by ``headers.data_rows``."""
        return cls.of_rows(data_rows.filter((F.col("file") == file) & (F.col("sheet") == sheet)), titles, sheet)

    @classmethod
    def of_rows(cls, data_rows: DataFrame, titles: list[str], name: str = "Sheet1", keys: tuple[str, ...] = ()) -> Sheet:
        """Rows of the long form that all have these titles, told apart by ``keys``."""
        cells = [F.get("cells", F.lit(i)) for i in range(len(titles))]
        return cls(
            data_rows.select(
                *keys, F.col("row_no").alias("pos"),
                *[c["text"].alias(f"c{i}") for i, c in enumerate(cells)],
                *[c["kind"].alias(f"k{i}") for i, c in enumerate(cells)],
            ),
            titles,
            name,
            keys,
        )

    def values(self) -> dict[str, tuple[str, Value]]:
        """Title -> (column, value). When a title repeats, its last column wins."""
        types = {f.name: f.dataType for f in self.rows.schema.fields}
        out: dict[str, tuple[str, Value]] = {}
        for i, title in enumerate(self.titles):
            kind = F.col(f"k{i}") if f"k{i}" in types else None
            out[title] = (f"c{i}", Value(F.col(f"c{i}"), types[f"c{i}"], kind))
        return out


@dataclass
class Cleaned:
    """Result of :func:`clean`; every member is lazy. ``whole`` has the rows of both ``kept`` and ``dropped``."""

    marked: DataFrame
    kept: DataFrame
    dropped: DataFrame
    schema: list[dict]
    whole: DataFrame | None = None

    def counts(self) -> DataFrame:
        """Rows read, kept and dropped."""
        seen = self.marked.agg(F.count(F.lit(1)).alias("input_count"))
        lost = self.dropped.agg(F.count(F.lit(1)).alias("dropped_count"))
        both = seen.select("input_count", F.lit(0).alias("dropped_count")).unionByName(
            lost.select(F.lit(0).alias("input_count"), "dropped_count")
        )
        total = both.agg(F.sum("input_count").alias("input_count"), F.sum("dropped_count").alias("dropped_count"))
        return total.select("input_count", (F.col("input_count") - F.col("dropped_count")).alias("kept_count"), "dropped_count")

    def dq(self) -> DataFrame:
        return dq_stats(self.kept, self.schema)


def rule_dicts(rules: DataFrame, file: str, sheet: str) -> list[dict]:
    """The few rules of one sheet, as the plain specs that :func:`clean` compiles."""
    rows = rules.filter((F.col("file") == file) & (F.col("sheet") == sheet)).orderBy("seq").collect()
    return [{**r.asDict(), "spec": r["spec"].asDict()} for r in rows]


def schema_dicts(schema: DataFrame, file: str, sheet: str) -> list[dict]:
    rows = schema.filter((F.col("file") == file) & (F.col("sheet") == sheet)).orderBy("position").collect()
    return [{"include": True, **r.asDict()} for r in rows]


def override_rules(rules: list[dict], enabled: dict[str, bool] | None = None, replace: list[dict] | None = None) -> list[dict]:
    """Caller's rule list if given; then single rules switched on or off by id."""
    base = rules if not replace else replace
    return [{**r, "enabled": (enabled or {}).get(r.get("id"), r.get("enabled"))} for r in base]


def keep_all_rows(rules: list[dict]) -> list[dict]:
    """Same rules without the ones that remove rows."""
    return [{**r, "enabled": r.get("enabled") and r["kind"] not in ("filter", "dedupe")} for r in rules]


def not_in(v: Column, values: Iterable) -> Column:
    """True when the value is not in the list, ignoring case; NULL compares as ``none``."""
    return ~F.lower(F.coalesce(v, F.lit("None"))).isin([str(x).lower() for x in values])


def greater_than(v: Column, bound: float) -> Column:
    return F.coalesce(casts.to_number(v) > bound, F.lit(False))


def not_matching(v: Column, pattern: str) -> Column:
    return ~F.coalesce(v.rlike("(?i)" + pattern), F.lit(False))


def _keeps(spec: dict, text: Column) -> Column:
    op = spec["op"]
    if op == "not_empty":
        return ~is_blank(text)
    if op == "gt":
        return greater_than(text, float(spec["value"]))
    if op == "regex_not":
        return not_matching(text, spec["value"])
    if op == "not_in":
        return not_in(text, spec.get("value") or [])
    return F.lit(True)


def clean(sheet: Sheet, rules: list[dict], schema: list[dict], ampm: bool = False) -> Cleaned:
    """Compile the enabled rules and run them over the rows of ``sheet``."""
    active = [r for r in rules if r.get("enabled")]
    values = sheet.values()
    rows = sheet.rows

    # Combine reads the original cells, so it is computed next to them, before the casts.
    combined: dict[str, str] = {}
    for i, r in enumerate(x for x in active if x["kind"] == "combine_datetime"):
        spec = r["spec"]
        nothing = (None, Value(F.lit(None).cast("string")))
        date, time = values.get(spec["date_col"], nothing)[1], values.get(spec["time_col"], nothing)[1]
        rows = rows.withColumn(
            f"m{i}", F.concat(F.nullif(date.iso_date(), F.lit("")), F.lit("T"), time.time_of_day(ampm))
        )
        combined[spec["target"]] = f"m{i}"

    casted: dict[str, Column] = {}
    for r in (x for x in active if x["kind"] == "cast"):
        title, to = r["spec"]["column"], r["spec"]["to"]
        if title not in values:
            continue
        name, value = values[title]
        if to == "string":
            new = Value(value.number_text())
        elif to == "currency":
            new = Value(casts.to_number(value.text), T.DoubleType())
        elif to == "date":
            new = Value(value.iso_date())
        else:
            continue
        keep_blank = new.dtype == T.StringType() and value.dtype == T.StringType()
        casted[name] = F.when(~is_blank(value.text), new.col).otherwise(value.col) if keep_blank else F.when(~is_blank(value.text), new.col)
        values[title] = (name, Value(casted[name], new.dtype))
    if casted:
        rows = rows.withColumns(casted)
    values = {t: (name, Value(F.col(name), v.dtype, v.kind)) for t, (name, v) in values.items()}

    reason = F.lit(None).cast("string")
    for r in reversed([x for x in active if x["kind"] == "filter"]):
        target = values.get(r["spec"]["column"])
        text = target[1].text if target else F.lit(None).cast("string")
        reason = F.when(~_keeps(r["spec"], text), F.lit(r["title"])).otherwise(reason)
    marked = rows.withColumn("reason", reason)

    shown = [values[t][1].text for t in dict.fromkeys(sheet.titles)] + [F.col(m) for m in combined.values()]
    sample = F.coalesce(*[F.when(~is_blank(t), t) for t in shown])
    live = marked.filter(F.col("reason").isNull()).drop("reason")
    place = [*sheet.keys, "pos"]
    held = [*place, *sheet.carried]
    dropped = marked.filter(F.col("reason").isNotNull()).select(*held, "reason", sample.alias("sample"))
    flagged = marked
    if any(r["kind"] == "dedupe" for r in active):
        # The first row of each group of equal rows: a map-side aggregate, so no task sees all copies.
        key = [c for c in live.columns if c != "pos" and c not in sheet.carried]
        first = live.groupBy(*key).agg(F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in sheet.carried])
        again = live.join(first.select(*place), place, "left_anti")
        dropped = dropped.unionByName(again.select(*held, F.lit(DUPLICATE).alias("reason"), sample.alias("sample")))
        found = marked.join(first.select(*place, F.lit(True).alias("stays")), place, "left")
        flagged = found.withColumn("reason", F.coalesce("reason", F.when(F.col("stays").isNull(), DUPLICATE)))
        live = first

    hidden = [F.col(k).alias(f"_{k}") for k in place]
    told = [F.col("reason").alias("_reason"), F.when(F.col("reason").isNotNull(), sample).alias("_sample")]
    names = projection(schema, values, combined)
    whole = flagged.select(*hidden, *told, *names)
    return Cleaned(marked, live.select(*held, *names), dropped, schema, whole)


def projection(schema: list[dict], values: dict, combined: dict[str, str]) -> list[Column]:
    """Included schema columns under their canonical names; of equal names the last one wins."""
    out: dict[str, Column] = {}
    for c in schema:
        if not c.get("include", True):
            continue
        if c.get("time_source"):
            name = combined.get(c["name"]) or combined.get("event_timestamp")
            out[c["name"]] = F.col(name) if name else F.lit(None).cast("string")
        elif c["source"] in values:
            out[c["name"]] = values[c["source"]][1].shown()
        else:
            out[c["name"]] = F.lit(None).cast("string")
    return [v.alias(n) for n, v in out.items()]


def dq_stats(kept: DataFrame, schema: list[dict], keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of blank values and number of distinct values (NULL is one of them) per column, for equal ``keys`` each."""
    types = {f.name: f.dataType for f in kept.schema.fields}
    declared = {c["name"]: c["type"] for c in schema if c.get("include", True)}
    pairs = [
        F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), text_of(F.col(n), types[n]).alias("text"))
        for n, t in declared.items()
    ]
    long = kept.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.*")
    seen = long.groupBy(*keys, "name", "type", F.coalesce("text", F.lit("None")).alias("shown")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_blank(F.col("text"))).alias("blank")
    )
    return seen.groupBy(*keys, "name", "type").agg(
        F.round(F.sum("blank") / F.sum("n") * 100, 1).alias("null_pct"), F.count(F.lit(1)).alias("distinct")
    )


def dropped_report(cleaned: Cleaned, limit: int | None = None) -> DataFrame:
    """Dropped rows with reason and sample value: filtered rows first, then duplicates, in row order."""
    late = F.when(F.col("reason") == DUPLICATE, 1).otherwise(0)
    if limit is None:
        return cleaned.dropped
    return cleaned.dropped.orderBy(late, "pos").limit(limit)


def sheet_titles(titles: DataFrame, file: str, sheet: str) -> list[str]:
    rows = titles.filter((F.col("file") == file) & (F.col("sheet") == sheet)).orderBy("col_index").collect()
    return [r["source"] for r in rows]


__all__ = [
    "SHEET", "Cleaned", "Sheet", "Value", "clean", "dq_stats", "dropped_report", "greater_than", "keep_all_rows", "not_in",
    "not_matching", "override_rules", "rule_dicts", "schema_dicts", "sheet_titles",
]
