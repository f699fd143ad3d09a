"""First k rows of every group without sorting or collecting a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.session import durable


def first_k(df: DataFrame, keys: list[str], order: str, k: int, label: str = "first-k") -> DataFrame:
    """Rows 1..k of each group by ``order`` (unique within a group), with their ``rank``.

    The order values of a group are hashed into 8*k classes and only the minimum of each class is
    kept (a map-side aggregate of fixed size). The k-th smallest of these minima is an upper bound
    of the k-th smallest value, so rows beyond it are filtered before the ranking shuffle. A group
    that fills fewer than k classes has no bound; such a group is tiny, as its values spread evenly.
    """
    lows = df.groupBy(*keys, F.pmod(F.xxhash64(order), F.lit(8 * k)).alias("_class")).agg(
        F.min(order).alias("_bound")
    )
    by_low = Window.partitionBy(*keys).orderBy("_bound")
    bounds = durable(
        lows.withColumn("_r", F.row_number().over(by_low)).filter(F.col("_r") == k).select(*keys, "_bound"),
        label,
    )
    near = df.join(bounds, keys, "left").filter(
        F.col("_bound").isNull() | (F.col(order) <= F.col("_bound"))
    )
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter(F.col("rank") <= k).drop("_bound")
