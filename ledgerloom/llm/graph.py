"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import durable


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of whole numbers to (node, root): the smallest node each linked node can reach.

    Every round points all neighbours of a node, and the node, to the smallest of them, until nothing changes; chains
    shorten by half at least. Lists of neighbours are joined, never gathered, so a hub is no heavier than its links.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = durable(both, "links")
    mark = None
    while True:
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        stars = durable(both.join(low, "a").select("b", "low").union(low.select(F.col("a").alias("b"), "low")).filter("b <> low").distinct(), "stars")
        # unchanged from the last round: every node points to its root alone
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("b", "low").cast("decimal(38,0)"))).first())
        if now == mark:
            return stars.select(F.col("b").alias("node"), F.col("low").alias("root")).union(stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        mark = now
        both = stars.select(F.col("b").alias("a"), F.col("low").alias("b")).union(stars.select(F.col("low").alias("a"), "b"))
