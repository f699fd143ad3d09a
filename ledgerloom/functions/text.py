"""Text expressions: blank test, names, and the text form of typed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

# Characters treated as white space when trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once for each row. Branches of a condition would compute it anew wherever they name it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def trimmed(c: Column) -> Column:
    """As :func:`strip`; a text between printable ASCII characters is taken as it is. ``c`` should be cheap, it is named often."""

    def printable(x: Column) -> Column:
        return (x >= "!") & (x < "\x7f")

    return F.when(printable(c) & printable(c.substr(-1, 1)), c).otherwise(strip(c))


def is_blank(c: Column) -> Column:
    """NULL or only white space.

    Trimming copies and searches the text; one that begins with a printable ASCII character needs none.
    """
    return c.isNull() | (~((c >= "!") & (c < "\x7f")) & (strip(c) == ""))


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def snake(c: Column) -> Column:
    """Column or table name in snake case; never empty, never starting with a digit."""
    joined = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_")
    trimmed = F.btrim(joined, F.lit("_"))
    safe = F.regexp_replace(trimmed, "^([0-9])", "col_$1")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("column"))


def norm_name(c: Column) -> Column:
    """Comparison form of a name: lower case, runs of other characters become one space."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def _double_text(x: Column) -> Column:
    text = x.cast("string")
    size = F.abs(x)
    fixed = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    digits = F.regexp_extract(text, r"E-?([0-9]+)$", 1)
    power = F.concat(
        F.when(text.contains("E-"), "-").otherwise("+"),
        F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
    )
    in_plain_range = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    # most numbers are written as they are
    usual = ((size >= 1e-3) & (size < 1e7)) | (x == 0)
    return (
        F.when(usual, text)
        .when(F.isnan(x), "nan")
        .when(text == "Infinity", "inf")
        .when(text == "-Infinity", "-inf")
        .when(in_plain_range, plain)
        .when(text.contains("E"), F.concat(mantissa, F.lit("e"), power))
        .otherwise(text)
    )


def text_of(c: Column, dtype: T.DataType) -> Column:
    """Text form of a typed column: `58.0`, `12345678.5`, `1e+16`, `True`, `2024-01-05 10:00:00`.

    Digits are those of the JVM; before Java 19 a double of 17 digits may show one more than needed.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _double_text(c.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(
            F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        )
    return c.cast("string")


def kind_of(dtype: T.DataType) -> str:
    """Cell kind that a typed column produces."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "str"
