"""Column statistics, types, roles and target types over long-form cells.

Every cell is first reduced to one row per (column, text) with counts per cell kind. That aggregate
combines map-side, so a value shared by a third of all rows costs one row per task, and each pattern
is tested once per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.casts import parse_double, to_number
from ledgerloom.functions.text import blank_to_null, kind_of, snake, strip, text_of
from ledgerloom.operators.firstk import first_k
from ledgerloom.operators.headers import SHEET
from ledgerloom.session import durable

COLUMN = [*SHEET, "col_index"]
HEAD_SAMPLE = 5
DISTINCT_SAMPLE = 30

# Shapes of cell text.
CURRENCY_SIGN = r"^-?\$\s?[0-9,]+(\.[0-9]+)?$"
CURRENCY_CENTS = r"^-?[0-9,]+\.[0-9]{2}$"
NUMBER = r"^-?[0-9,]+(\.[0-9]+)?$"
DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
TIME = r"(?i)^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?(\s?[ap]m)?$"
LEADING_ZERO = r"^0[0-9]+$"
FLAG_WORDS = ["true", "false", "yes", "no", "y", "n", "t", "f"]

# Words in column titles.
MEASURE_HINT = (
    r"(?i)(qty|quantity|units?|sold|cases?|bottles?|amount|amt|revenue|sales|net|gross|price|cost|fob"
    r"|msrp|total|count|sum|volume|liters?)"
)
ID_HINT = r"(?i)(sku|upc|ean|gtin|barcode|code|key|id$|_id|\bid\b)"
DATE_HINT = r"(?i)(date|day|month|year|period)"
TIME_HINT = r"(?i)\btime\b"


def cells_of_table(df: DataFrame, file: str, sheet: str, order: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells and column titles of a typed table, so that tables and sheets share one profiler."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str) -> Column:
        text = text_of(F.col(name), types[name])
        return F.struct(F.when(text.isNotNull(), kind_of(types[name])).alias("kind"), text.alias("text"))

    cells = df.select(
        F.lit(file).alias("file"),
        F.lit(sheet).alias("sheet"),
        F.col(order).alias("row_no"),
        F.posexplode(F.array(*[cell(c) for c in columns])).alias("col_index", "cell"),
    ).select(*SHEET, "row_no", "col_index", "cell.kind", "cell.text")
    titles = df.sparkSession.createDataFrame(
        [(file, sheet, i, c) for i, c in enumerate(columns)], "file string, sheet string, col_index int, source string"
    )
    return cells, titles


def weighted_values(cells: DataFrame) -> DataFrame:
    """One row per (column, text); blank cells share the NULL text."""
    kind = F.col("kind")
    return (
        cells.withColumn("text", blank_to_null(F.col("text")))
        .groupBy(*COLUMN, "text")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(kind == "str").alias("n_str"),
            F.count_if(kind.isin("int", "float")).alias("n_num"),
            F.count_if(kind == "bool").alias("n_bool"),
            F.count_if(kind.isin("date", "datetime")).alias("n_date"),
            F.count_if(kind == "time").alias("n_time"),
            F.min("row_no").alias("first_pos"),
        )
    )


def column_stats(values: DataFrame) -> DataFrame:
    """Counts, fractions turned into a type, and flags: one row per column."""
    text, n, n_str = F.col("text"), F.col("n"), F.col("n_str")
    trimmed = strip(text)
    number = to_number(text)
    native = parse_double(text)

    def weight(test: Column, count: Column = n_str) -> Column:
        return F.when(test, count).otherwise(0)

    currency = (trimmed.rlike(CURRENCY_SIGN) | trimmed.rlike(CURRENCY_CENTS)) & ~trimmed.rlike("^-?[0-9]+$")
    sums = (
        values.withColumn("number", number)
        .groupBy(*COLUMN)
        .agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(text.isNotNull(), n)), F.lit(0)).alias("filled"),
            F.count("text").alias("distinct"),
            F.sum(F.col("n_bool") + weight(F.lower(trimmed).isin(FLAG_WORDS))).alias("w_bool"),
            F.sum(F.col("n_date") + weight(text.rlike(DATE))).alias("w_date"),
            F.sum(F.col("n_time") + weight(trimmed.rlike(TIME))).alias("w_time"),
            F.sum(weight(currency, n)).alias("w_currency"),
            F.sum(weight(text.contains("$"))).alias("w_dollar"),
            F.sum(F.col("n_num") + weight(trimmed.rlike(NUMBER))).alias("w_number"),
            F.sum(weight(trimmed.rlike(LEADING_ZERO), n)).alias("w_zero"),
            F.bool_and(F.when(text.isNotNull(), F.coalesce(F.col("number") == 0, F.lit(False)))).alias("only_zero"),
            F.bool_and(
                F.when(
                    text.isNotNull(),
                    (F.col("n_num") == n) & F.coalesce((native % 1 == 0) & (F.abs(native) >= 1e8), F.lit(False)),
                )
            ).alias("only_big"),
            F.min("number").alias("low"),
            F.max("number").alias("high"),
            F.min_by(text, F.when(text.isNotNull(), F.col("first_pos"))).alias("first_text"),
        )
    )
    def share(c):
        return F.when(F.col("filled") > 0, F.col(c) / F.col("filled")).otherwise(0.0)

    flag = (F.col("distinct") <= 2) & (share("w_bool") > 0.9)
    date = ~flag & (share("w_date") > 0.8)
    time = ~date & (share("w_time") > 0.8)
    empty = F.col("filled") == 0
    typed = sums.withColumns(
        {
            "is_currency": (share("w_currency") > 0.6) | (share("w_dollar") > 0.5),
            "numeric": share("w_number") > 0.85,
        }
    ).withColumn(
        "type",
        F.when(empty, "empty")
        .when(flag, "boolean")
        .when(date, "date")
        .when(time, "time")
        .when(F.col("is_currency"), "currency")
        .when(F.col("numeric"), "number")
        .otherwise("string"),
    )
    measured = F.col("numeric") | F.col("is_currency")
    return typed.select(
        *COLUMN,
        "row_count",
        "type",
        F.when(empty, 1.0).otherwise(F.round((F.col("row_count") - F.col("filled")) / F.col("row_count"), 4)).alias("null_rate"),
        "distinct",
        F.when(measured, F.col("low")).alias("min"),
        F.when(measured, F.col("high")).alias("max"),
        (F.col("numeric") & F.coalesce("only_zero", F.lit(False))).alias("all_zero"),
        (share("w_zero") > 0.5).alias("leading_zero"),
        (F.col("numeric") & F.coalesce("only_big", F.lit(False))).alias("big_int"),
        (empty | (F.col("distinct") == 1)).alias("constant"),
        "is_currency",
        "numeric",
        "first_text",
    )


def column_samples(cells: DataFrame, values: DataFrame) -> DataFrame:
    """First five values and first thirty distinct values of every column, in row order."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct("rank", "text")))  # at most k per column
        return df.groupBy(*COLUMN).agg(F.transform(pairs, lambda p: p["text"]).alias(name))

    filled_cells = cells.filter(blank_to_null(F.col("text")).isNotNull()).select(*COLUMN, "row_no", "text")
    seen = values.filter(F.col("text").isNotNull()).select(*COLUMN, "first_pos", "text")
    head = listed(first_k(filled_cells, COLUMN, "row_no", HEAD_SAMPLE, "head"), "sample")
    spread = listed(first_k(seen, COLUMN, "first_pos", DISTINCT_SAMPLE, "spread"), "distinct_sample")
    return spread.join(head, COLUMN)


def role_of(name: Column) -> Column:
    """Part a column plays: ignore, timestamp, id, measure or dimension."""
    useless = (F.col("type") == "empty") | F.col("all_zero") | (F.col("constant") & (F.col("row_count") >= 3))
    return (
        F.when(useless, "ignore")
        .when(F.col("type").isin("date", "time") | name.rlike(DATE_HINT) | name.rlike(TIME_HINT), "timestamp")
        .when(name.rlike(ID_HINT) | F.col("leading_zero") | F.col("big_int"), "id")
        .when(F.col("type").isin("number", "currency"), "measure")
        .otherwise("dimension")
    )


def target_type_of(name: Column) -> Column:
    """Type the cleaned column is declared with."""
    whole = F.coalesce(parse_double(strip(F.col("first_text"))) % 1 == 0, F.lit(False))
    return (
        F.when(F.col("role") == "id", "string")
        .when(F.col("type") == "currency", "decimal")
        .when((F.col("role") == "timestamp") | (F.col("type") == "date"), "date")
        .when(F.col("type") == "time", "time")
        .when((F.col("type") == "number") & whole & ~name.rlike(MEASURE_HINT), "integer")
        .when(F.col("type") == "number", "decimal")
        .otherwise("string")
    )


def describe_columns(stats: DataFrame, titles: DataFrame) -> DataFrame:
    """Statistics with title, canonical name, role and target type."""
    return (
        stats.join(titles, COLUMN)
        .withColumn("canonical", snake(F.col("source")))
        .withColumn("role", role_of(F.col("source")))
        .withColumn("ttype", target_type_of(F.col("source")))
    )


def profile_columns(cells: DataFrame, titles: DataFrame, samples: bool = True) -> DataFrame:
    """Full column profile of every sheet in one job; ``samples=False`` leaves the examples out."""
    values = weighted_values(cells)
    if not samples:
        return describe_columns(column_stats(values), titles)
    values = durable(values, "values")  # read by the statistics and by the samples
    described = describe_columns(column_stats(values), titles)
    return described.join(column_samples(cells, values), COLUMN, "left").withColumns(
        {
            "sample": F.coalesce("sample", F.array().cast("array<string>")),
            "distinct_sample": F.coalesce("distinct_sample", F.array().cast("array<string>")),
        }
    )
