"""Table export. Both formats are written in parallel, one file per task, with every row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str) -> None:
    """Header line, NULL as an empty field; blanks inside values are kept."""
    df.write.mode("overwrite").options(
        header=True, nullValue="", emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One object per line, NULL fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
