"""Sheet layout: trailing blank rows, header row, sheet kind, and cells below the header.

Input everywhere is ``sheet_rows(file, sheet, row_no, cells array<struct<kind,text>>)``. ``row_no``
orders the rows of a sheet; workbook readers number them 0, 1, 2, ... (``dense=True``), delimited
files only promise an increasing number (``dense=False``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.text import is_blank, strip
from ledgerloom.operators.firstk import first_k
from ledgerloom.session import durable

SHEET = ["file", "sheet"]

# Sheet names that announce settings or notes instead of data.
META_NAME = (
    r"(?i)^(filters?|extra ?info|.*info|cover|notes?|readme|summary|legend|parameters?|settings?)$"
)
HEADER_SCAN = 25
HEADER_LOOK_AHEAD = 5


def filled(cells: Column) -> Column:
    """Number of cells with a value."""
    return F.size(F.filter(cells, lambda c: ~is_blank(c["text"])))


def has_value(cells: Column) -> Column:
    return F.exists(cells, lambda c: ~is_blank(c["text"]))


def trim_trailing_blank(rows: DataFrame) -> DataFrame:
    """Drop the blank rows after the last row with a value, sheet by sheet."""
    last = durable(
        rows.filter(has_value(F.col("cells"))).groupBy(*SHEET).agg(F.max("row_no").alias("_last")), "last-row"
    )
    return rows.join(last, SHEET).filter(F.col("row_no") <= F.col("_last")).drop("_last")


def blank_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(~has_value(F.col("cells")))


def detect_header(rows: DataFrame, dense: bool = True) -> DataFrame:
    """One row per sheet: ``header_row`` (position), ``header_no`` (its row_no) and ``header`` cells.

    Only the first 30 rows of each sheet are looked at.
    """
    reach = HEADER_SCAN + HEADER_LOOK_AHEAD
    if dense:
        top = rows.filter(F.col("row_no") < reach).withColumn("pos", F.col("row_no").cast("bigint"))
    else:
        top = first_k(rows, SHEET, "row_no", reach, "top-rows").withColumn("pos", F.col("rank") - 1).drop("rank")

    def titled(c: Column) -> Column:
        return (
            (c["kind"] == "str")
            & ~is_blank(c["text"])
            & (F.length(c["text"]) < 60)
            & ~strip(c["text"]).rlike(r"^-?[0-9]+(\.[0-9]+)?$")
        )

    ahead = Window.partitionBy(*SHEET).orderBy("pos").rowsBetween(1, HEADER_LOOK_AHEAD)
    scored = (
        top.withColumn("fill", filled(F.col("cells")))
        .withColumn("below", F.avg(F.nullif(F.col("fill"), F.lit(0))).over(ahead))
        .withColumn("titles", F.size(F.filter("cells", titled)))
        .withColumn(
            "score",
            F.when(
                (F.col("pos") < HEADER_SCAN) & (F.col("fill") >= 2) & (F.col("below") >= 2),
                F.col("titles") * 2 + F.least(F.col("below"), F.col("fill")) - F.col("pos") * F.lit(0.6).cast("double"),
            ),
        )
    )
    # A sheet without a candidate falls back to its first row: NULL scores sort behind real ones.
    best = F.struct(F.coalesce("score", F.lit(float("-inf"))).alias("s"), (-F.col("pos")).alias("p"))
    return scored.groupBy(*SHEET).agg(
        F.max_by(F.struct(F.col("pos").alias("header_row"), F.col("row_no").alias("header_no"), "cells"), best).alias("h")
    ).select(*SHEET, "h.header_row", "h.header_no", F.col("h.cells").alias("header"))


def classify_sheets(rows: DataFrame, headers: DataFrame | None = None, dense: bool = True) -> DataFrame:
    """Kind (`data` or `metadata`), header row, width and number of rows below the header."""
    headers = durable(detect_header(rows, dense), "headers") if headers is None else headers
    counts = (
        rows.join(headers.select(*SHEET, "header_no"), SHEET)
        .groupBy(*SHEET)
        .agg(F.count_if(F.col("row_no") > F.col("header_no")).alias("data_rows"))
    )
    small = (F.col("width") < 3) | (F.col("data_rows") < 1)
    notes = strip(F.col("sheet")).rlike(META_NAME) & (F.col("width") < 4)
    return (
        headers.withColumn("width", filled(F.col("header")))
        .join(counts, SHEET)
        .withColumn("kind", F.when(small | notes, "metadata").otherwise("data"))
        .select(*SHEET, "kind", "header_row", "header_no", "width", "data_rows", "header")
    )


def header_titles(header: Column) -> Column:
    """Titles of a header row; a blank one becomes ``column_<n>``."""
    title = lambda c, i: F.when(is_blank(c["text"]), F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(
        strip(c["text"])
    )
    return F.transform(header, title)


def layout(header: Column) -> Column:
    """A short name that equal lists of titles share."""
    return F.concat(F.lit("t"), F.substring(F.sha1(F.to_json(header_titles(header)).cast("binary")), 1, 12))


def sheet_columns(sheets: DataFrame) -> DataFrame:
    """Column titles of the data sheets; a blank title becomes ``column_<n>``."""
    return sheets.filter(F.col("kind") == "data").select(
        *SHEET, F.posexplode(header_titles(F.col("header"))).alias("col_index", "source")
    )


def data_rows(rows: DataFrame, sheets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Non-blank rows below the header of the data sheets, cut or padded to the header width.

    ``keep`` are further columns of ``sheets`` that every row gets.
    """
    heads = sheets.filter(F.col("kind") == "data").select(*SHEET, *keep, "header_no", F.size("header").alias("_w"))
    return (
        rows.join(heads, SHEET)
        .filter((F.col("row_no") > F.col("header_no")) & has_value(F.col("cells")))
        .select(*SHEET, *keep, "row_no", F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: F.get("cells", i)).alias("cells"))
    )


def melt_cells(rows: DataFrame) -> DataFrame:
    """One row per cell: ``file, sheet, row_no, col_index, kind, text``; missing cells are NULL."""
    return rows.select(*SHEET, "row_no", F.posexplode("cells").alias("col_index", "cell")).select(
        *SHEET, "row_no", "col_index", "cell.kind", "cell.text"
    )
