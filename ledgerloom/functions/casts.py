"""Value conversions. None of them raises: text that does not fit gives NULL (or itself, for dates)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ledgerloom.functions.text import WHITE_SPACE, is_blank, once, text_of, trimmed

# Plain decimal or exponent notation. "nan", "inf" and trailing type letters stay out.
NUMERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Column types stored as a floating point number and as a whole number.
NUMERIC_TYPES = ("number", "decimal", "currency", "numeric", "float", "double")
INTEGER_TYPES = ("integer", "int", "bigint", "smallint")


def parse_double(text: Column) -> Column:
    return once(text, lambda t: F.when(t.rlike(NUMERAL), t.try_cast("double")))


def to_number(c: Column) -> Column:
    """Currency and number text: `,`, `$`, `%` and white space are dropped before parsing."""
    return parse_double(F.translate(c, ",$%" + WHITE_SPACE, ""))


def typed_cell(text: Column, keep_leading_zeros: bool = False) -> Column:
    """Cell struct for one field of a delimited file: whole number, decimal number or text."""
    # A number begins with a sign, a point or a digit; most other texts need no pattern.
    looks_numeric = (text >= "-") & (text < ":") & text.rlike(r"^-?[0-9]*\.?[0-9]*$") & text.rlike("[0-9]")
    if keep_leading_zeros:
        looks_numeric = looks_numeric & ~text.rlike("^-?0[0-9]+$")
    zeros = text.startswith("0") | text.startswith("-0")
    whole = F.when(~zeros, text).when(text.rlike("^-?0+$"), "0").otherwise(F.regexp_replace(text, "^(-?)0+", "$1"))

    def cell(kind: str, shown: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), shown.alias("text"))

    number = F.when(text.contains("."), cell("float", text_of(text.try_cast("double"), T.DoubleType()))).otherwise(cell("int", whole))
    return F.when(text != "", F.when(looks_numeric, number).otherwise(cell("str", text)))


def cast_text(c: Column, dtype: T.DataType) -> Column:
    """Identifier to text: a whole-valued float is written with all its digits and no `.0`, however large."""
    text = text_of(c, dtype)
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return text
    return F.when(c % 1 == 0, F.format_string("%.0f", c.cast("double") + F.lit(0.0))).otherwise(text)


def iso_date(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """ISO date from `Y-M-D` or `M/D/Y` prefixes; other text is returned trimmed, unchecked."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")

    def rendered(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    def month_first(p: Column) -> Column:
        full_year = F.when(F.length(p[2]) == 4, p[2]).otherwise(F.concat(F.lit("20"), p[2]))
        return rendered(full_year, p[0], p[1])

    def read(text: Column) -> Column:
        found = F.regexp_extract(text, "^(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})", 0)
        return once(
            found,
            lambda f: F.when(f.contains("/"), once(F.split(f, "/"), month_first))
            .when(f.contains("-"), once(F.split(f, "-"), lambda p: rendered(p[0], p[1], p[2])))
            .otherwise(text),
        )

    return once(text_of(c, dtype), lambda t: once(trimmed(t), read))


def time_of_day(c: Column, dtype: T.DataType = T.StringType(), ampm: bool = False) -> Column:
    """`HH:mm:ss` from text, a timestamp or a fraction of a day; midnight when there is no time."""
    midnight = F.lit("00:00:00")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(c, "HH:mm:ss"), midnight)
    if isinstance(dtype, T.NumericType):
        x = c.cast("double")
        seconds = F.bround((x - x.cast("bigint")) * 86400).cast("bigint")

        def two_digits(v: Column) -> Column:
            return F.when(v.between(0, 9), F.concat(F.lit("0"), v.cast("string"))).otherwise(v.cast("string"))

        within = F.pmod(seconds, F.lit(3600))
        shown = F.concat_ws(
            ":",
            two_digits(F.floor(seconds / 3600)),
            two_digits(F.floor(within / 60)),
            two_digits(F.pmod(seconds, F.lit(60))),
        )
        return F.when(c.isNotNull(), shown).otherwise(midnight)
    text = text_of(c, dtype)
    clock = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
    if not ampm:
        # H:MM, HH:MM, H:MM:SS or HH:MM:SS
        padded = lambda h: F.concat(F.lit("0"), h, F.lit(":00")).substr(F.locate(":", h) - 1, F.lit(8))
        return once(F.regexp_extract(text, clock, 0), lambda h: F.when(h != "", padded(h)).otherwise(midnight))
    hour = F.lpad(F.regexp_extract(text, clock, 1), 2, "0")
    number = hour.try_cast("int")
    late = text.rlike(r"(?i)[0-9]\s?pm") & (number < 12)
    noon = text.rlike(r"(?i)[0-9]\s?am") & (number == 12)
    hour = F.when(late, (number + 12).cast("string")).when(noon, "00").otherwise(hour)
    second = F.coalesce(F.nullif(F.regexp_extract(text, clock, 3), F.lit("")), F.lit("00"))
    shown = F.concat_ws(":", hour, F.regexp_extract(text, clock, 2), second)
    return F.when(text.rlike(clock), shown).otherwise(midnight)


def date_and_time(
    date: Column, time: Column, date_type: T.DataType = T.StringType(), time_type: T.DataType = T.StringType(),
    ampm: bool = False,
) -> Column:
    """One ISO timestamp text. A missing date gives NULL rather than a text made from nothing."""
    day = F.nullif(iso_date(date, date_type), F.lit(""))
    return F.concat(day, F.lit("T"), time_of_day(time, time_type, ampm))


def storage_type(declared: str) -> T.DataType:
    """Physical type of a declared column type; dates, times and flags stay text."""
    if declared in NUMERIC_TYPES:
        return T.DoubleType()
    if declared in INTEGER_TYPES:
        return T.LongType()
    return T.StringType()


def coerce(c: Column, declared: str, dtype: T.DataType = T.StringType()) -> Column:
    """Convert a value for storage under ``declared``; blank and unreadable values become NULL."""
    text = text_of(c, dtype)
    if declared in NUMERIC_TYPES:
        if isinstance(dtype, T.NumericType):
            return c.cast("double")
        return parse_double(once(F.translate(text, ",$", ""), trimmed))
    if declared in INTEGER_TYPES:
        if isinstance(dtype, T.IntegralType):
            return c.cast("bigint")
        if isinstance(dtype, T.NumericType):
            return c.try_cast("bigint")
        return parse_double(once(F.translate(text, ",", ""), trimmed)).try_cast("bigint")
    return F.when(~is_blank(text), text)
