"""Connected components of a table of links by alternating large and small stars.

Rounds are logarithmic in the number of nodes. Each is a few joins over the links, and ends in a
checkpoint, so that lineage stays short. Nothing but two totals a round comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import cut


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut, by: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """node, root of every node of links (a, b) that isn't the smallest of its component; root is that.

    keep: what ends a round, `written` where other rounds lie before or behind these. by: how rows a node meet the links.
    """
    e = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        total = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (total["n"], total["s"]) == before or not total["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (total["n"], total["s"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(by(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(by(least), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = keep(moved.distinct())
