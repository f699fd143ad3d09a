"""Chat formatting with a grammar round trip (operator 4). DataFrame functions only.

A turn is rendered as ``### role: text</turn>`` and a line feed. Each rendered turn is parsed again; when the parser
does not give back the very turn (its text holds a control string, or looks escaped), the turn is rendered anew with
its control characters escaped. The parsed conversation is compared with its source at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import table

OPEN, MIDDLE, CLOSE, LINE = "### ", ": ", "</turn>", "\n"
SLASH = "\\"
#: What an escaped text writes for each character that control strings need.
ESCAPES = {"#": "\\h", "<": "\\l", ":": "\\c"}


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit(SLASH), F.lit(SLASH * 2))
    for char, written in ESCAPES.items():
        c = F.replace(c, F.lit(char), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    """Inverse of :func:`escape`; leaves all but its escapes as it is. Doubled backslashes part first, from the left."""

    def back(part: Column) -> Column:
        for char, written in ESCAPES.items():
            part = F.replace(part, F.lit(written), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(c, r"\\\\"), back), SLASH)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE + LINE))


def parse_turn(segment: Column) -> Column:
    """Turn of a segment (a rendered turn without its close), null unless the segment has one open mark, in front."""
    body = F.substr(segment, F.lit(len(OPEN) + 1))
    at = F.position(F.lit(MIDDLE), body)
    good = F.startswith(segment, F.lit(OPEN)) & (at > 0) & ~F.contains(body, F.lit(OPEN)) & ~F.contains(body, F.lit(CLOSE))
    turn = F.struct(
        unescape(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + len(MIDDLE))).alias("text")
    )
    return F.when(good, turn)


def segments(formatted: Column) -> Column:
    """Segments of a formatted conversation; the empty rest behind the last close is left out."""
    return F.filter(F.split(formatted, CLOSE + LINE), lambda s: s != "")


def survives(role: Column, text: Column, form: Column) -> Column:
    """Whether the rendered turn alone parses back to one turn, the source."""
    parts = segments(form)
    turn = parse_turn(parts[0])
    return F.coalesce((F.size(parts) == 1) & (turn["role"] == role) & (turn["text"] == text), F.lit(False))


def formatted(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to one row per conversation: conv_id, formatted, masks, turns.

    ``turns`` are those parsed from ``formatted``, in order; they are compared with the source, and a difference is an
    error. ``masks`` has for each turn the place (in characters) of the text the loss counts: start in ``formatted``,
    offset in the turn's segment, length; 0 long but for the assistant. A null role or text is empty, turns with equal
    numbers (null first) go by role and text, and repeated rows stay. A conversation is one output row, so it has to fit
    into one; its turns reach it sorted and are never compared with each other.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    plain, safe = rendered(role, text), rendered(escape(role), escape(text))
    as_is = survives(role, text, plain)
    form = clean.withColumn("as_is", as_is).withColumn("form", F.when(F.col("as_is"), plain).otherwise(safe))
    offset = F.char_length(F.when(F.col("as_is"), role).otherwise(escape(role))) + len(OPEN) + len(MIDDLE)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.char_length("form")
    placed = form.select(
        "conv_id", "role", "text", "form", size.alias("size"), offset.alias("offset"),
        F.row_number().over(order).alias("n"), (F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("at"),
    )
    counts = F.when(F.col("role") == "assistant", F.col("size") - F.col("offset") - len(CLOSE + LINE)).otherwise(0)
    mask = F.struct((F.col("at") + F.col("offset")).alias("start"), "offset", counts.alias("length"))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "form", F.struct("role", "text").alias("source"), mask.alias("mask")))).alias("rows"))
    out = rows.select("conv_id", F.array_join("rows.form", "").alias("formatted"), F.col("rows.mask").alias("masks"), F.col("rows.source").alias("source"))
    parsed = out.withColumn("turns", F.transform(segments(F.col("formatted")), parse_turn))
    same = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse back")))
    return parsed.select("conv_id", "formatted", "masks", same.alias("turns"))


def under_mask(formatted: Column, masks: Column) -> Column:
    """All text under the loss mask, unescaped, read from the formatted text."""
    marked = F.zip_with(segments(formatted), masks, lambda s, m: F.when(m["length"] > 0, unescape(F.substr(s, m["offset"] + 1, m["length"]))).otherwise(""))
    return F.array_join(marked, "")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, n AS turn, IF(n = 0, 'user', 'assistant') AS role FROM VALUES (0L), (1L) AS t(n)").withColumn("text", F.lit(text))
    done = formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.withColumn("loss", under_mask(F.col("formatted"), F.col("masks")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, contains(text,'### ') OR contains(text,'</turn>') OR contains(text,'\\') OR contains(text,'\h') OR contains(text,'\l') OR contains(text,'\c') AS clash,
  length(text) AS plain, length(replace(replace(replace(replace(text,'\','\\'),'#','\h'),'<','\l'),':','\c')) AS safe FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(plain) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + CASE WHEN clash THEN safe ELSE plain END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
