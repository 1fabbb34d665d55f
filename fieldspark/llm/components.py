"""Connected components of a link table by alternating large and small stars.

Large star: every neighbour above u is linked to u's smallest neighbour (u included). Small star: u and
its smaller neighbours are linked to the smallest of them. Both keep connectivity, and the table ends
as one star around each component's smallest node after a number of rounds that grows with the
logarithm of the longest chain. Each round is a combining aggregate and a join; links stay distributed, and
the links of a hot node are dealt to parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, stored


def _large(e: DataFrame, hint: str | None) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = both.where("b > a")
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return hot_join(up, least.hint(hint) if hint else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame, hint: str | None) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return hot_join(e, least.hint(hint) if hint else least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Every node above has one link, and no node below is above another."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame, hint: str | None = None) -> DataFrame:
    """(node, component): for each node of ``links`` (columns a, b; long) the smallest node it is connected with.

    hint: how the rounds join. Stored links compress so well that the optimizer may take millions for small.
    """
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    last = None
    while True:
        wide = stored(_large(e, hint), "wide")
        if last is not None:
            discard(last)
        e = last = stored(_small(wide, hint), "stars")
        discard(wide)
        if _are_stars(e):
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
