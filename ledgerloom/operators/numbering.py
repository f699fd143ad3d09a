"""Dense numbers 1..n in the order of a sort, by prefix sums over the tasks. No task sees all rows.

Rows are dealt by range and sorted in their task, the rows of each task are counted, and the exclusive sums of the counts
are where each task's numbers start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerloom.session import durable


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has the name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def numbered(df: DataFrame, order: list[Column], name: str, per: list[str] | None = None, total: str | None = None) -> DataFrame:
    """``df`` with ``name``, the place of each row (from 1) in the given order, within equal values of ``per`` if any.

    ``order`` must begin with the columns of ``per``, whose nulls count as equal; equal rows are numbered in any order.
    ``total``, if named, is the number of rows (of the row's group). The rows are written once, in order.
    """
    per, columns = per or [], df.columns
    mid, part = free_name(df, "_mid"), free_name(df, "_part")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id())
    # the upper bits of the id are the task's number
    rows = durable(dealt.withColumn(part, F.shiftright(mid, 33)), "numbered")
    runs = rows.groupBy(part, *per).agg(F.min(mid).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*per)
    before = F.coalesce(F.sum("_rows").over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [part, *per]
    starts = durable(
        runs.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], (before - F.col("_first") + 1).alias("_shift"), F.sum("_rows").over(group).alias("_total")), "runs"
    )
    same = rows[part] == starts["_k0"]
    for n, k in enumerate(per, 1):
        same &= rows[k].eqNullSafe(starts[f"_k{n}"])
    out = rows.join(starts, same)
    return out.select(*[rows[c] for c in columns], (rows[mid] + starts["_shift"]).alias(name), *([starts["_total"].alias(total)] if total else []))


def starts(counts: DataFrame, key: str, rows: str, name: str) -> DataFrame:
    """``key, name``: how many rows have a smaller key, from ``rows``, their number for each distinct ``key``. Nulls are smallest.

    Keys are dealt by range, so no task sees all of them. They are written three times, which is little if many rows share a key.
    """
    dealt = counts.select(key, rows).repartitionByRange(F.asc(key)).sortWithinPartitions(F.asc(key))
    held = durable(dealt.withColumn("_part", F.spark_partition_id()), "dealt-keys")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    parts = held.groupBy("_part").agg(F.sum(rows).alias("_all")).select("_part", F.coalesce(F.sum("_all").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(F.asc(key)).rowsBetween(Window.unboundedPreceding, -1)
    found = held.join(durable(parts, "dealt-parts"), "_part")
    return durable(found.select(key, (F.col("_base") + F.coalesce(F.sum(rows).over(within), F.lit(0))).alias(name)), "starts")


#: Places that lie together in one group of rows, as a power of two.
BLOCK = 16


def block_of(pos: Column) -> Column:
    """The group of a whole number; nulls come first."""
    return F.coalesce(F.shiftright(pos, BLOCK), F.lit(-(1 << 62)))


def block_starts(pos: DataFrame) -> DataFrame:
    """``_block, _before`` of the one column of ``pos``, whole numbers: how many rows lie in smaller blocks."""
    blocks = pos.select(block_of(F.col(pos.columns[0])).alias("_block")).groupBy("_block").agg(F.count(F.lit(1)).alias("_rows"))
    return starts(blocks, "_block", "_rows", "_before")


def numbered_in_blocks(df: DataFrame, pos: str, name: str, begin: DataFrame) -> DataFrame:
    """``df`` with ``name``, the place of each row (from 1) in the order of ``pos``. ``begin`` is :func:`block_starts` of the same rows.

    Rows move once, to the others of their block, and are not written. A block has 65,536 places, so a task holds whole blocks
    however many rows there are, unless a place repeats.
    """
    mine = df.withColumn("_block", block_of(F.col(pos)))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(F.asc(pos)))
    return mine.withColumn("_place", place).join(begin, "_block").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))
