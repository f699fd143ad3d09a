"""Profile all sheets of all files in one go, and the compact view of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators import headers as H, profile as P, rules as R
from ledgerloom.operators.headers import SHEET
from ledgerloom.session import durable


@dataclass
class Workbook:
    """Profile of every sheet: layout, titles, column profile, rules, schema, and the data rows.

    The data rows are written once, in a folder for each list of titles (``layout``), so what is run over sheets with
    the same titles reads their rows only.
    """

    sheets: DataFrame
    titles: DataFrame
    columns: DataFrame
    rules: DataFrame
    schema: DataFrame
    formats: DataFrame
    data_rows: DataFrame

    def summary(self) -> DataFrame:
        """One row per sheet; metadata sheets are listed without columns or rules."""
        per_column = self.columns.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("columns"), F.max("row_count").alias("filled_rows"))
        per_rule = self.rules.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rules"))
        rows = F.when(F.col("kind") == "data", F.coalesce("filled_rows", F.lit(0))).otherwise(F.col("data_rows"))
        return (
            self.sheets.join(per_column, SHEET, "left").join(per_rule, SHEET, "left").join(self.formats, SHEET, "left")
            .select(*SHEET, "kind", "header_row", rows.alias("row_count"), F.coalesce("columns", F.lit(0)).alias("columns"),
                    F.coalesce("rules", F.lit(0)).alias("rules"), "format_guess")
        )


def profile_workbook(rows: DataFrame, dense: bool = True, trim: bool = True) -> Workbook:
    """Run layout detection, profiling and rule generation over ``sheet_rows``.

    The rows are scanned a few times, never gathered: the layout needs the first rows of each sheet,
    the profile one aggregate over all cells. The number of jobs does not depend on the number of sheets.
    """
    if trim:
        rows = H.trim_trailing_blank(rows)
    sheets = durable(H.classify_sheets(rows, dense=dense), "sheets")
    titles = durable(H.sheet_columns(sheets), "titles")
    body = durable(H.data_rows(rows, sheets.withColumn("layout", H.layout(F.col("header"))), ("layout",)), "body", by=["layout"])
    cells = H.melt_cells(body)
    values = durable(P.weighted_values(cells), "values")
    described = P.describe_columns(P.column_stats(values), titles).join(P.column_samples(cells, values), P.COLUMN, "left")
    none = F.array().cast("array<string>")
    columns = durable(
        described.withColumns({"sample": F.coalesce("sample", none), "distinct_sample": F.coalesce("distinct_sample", none)}), "columns"
    )
    rules = durable(R.generate_rules(columns, values, sheets), "rules")
    schema = durable(R.generate_schema(columns), "schema")
    return Workbook(sheets, titles, columns, rules, schema, R.guess_format(titles), body)


def profile_payload(book: Workbook, matches: DataFrame) -> DataFrame:
    """Compact view per data sheet: row count, format and, as one JSON text, its columns."""
    entity = matches.select(*SHEET, "col_index", "entity")
    column = F.struct(
        "col_index", F.col("source").alias("name"), "type", "role", "entity", F.round(F.col("null_rate") * 100, 1).alias("nullPct"),
        "distinct", F.slice("distinct_sample", 1, 15).alias("examples"), "min", "max",
    )
    # One entry per column of the sheet.
    listed = book.columns.join(entity, [*SHEET, "col_index"], "left").groupBy(*SHEET).agg(
        F.max("row_count").alias("rows"), F.array_sort(F.collect_list(column)).alias("c")
    )
    bare = F.transform("c", lambda c: c.dropFields("col_index"))
    return listed.join(book.formats, SHEET, "left").select(*SHEET, "rows", F.col("format_guess").alias("format"), F.to_json(bare).alias("columns"))
