"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of a link but the least of each component, which is its name.

    Alternating large and small stars: in turn, the larger and the smaller neighbours of a node are
    linked to the least node of its neighbourhood, until the links stand still as one star for each
    component.  Rounds grow with the logarithm of the longest path.  Least neighbours are found by
    aggregates that combine before the shuffle and are joined back, so a node with very many links
    is no single task; each round is a written table.  Links that are stars need no further round.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    links = saved(links.select(high.alias("u"), low.alias("v")).filter("u <> v").distinct(), "links")
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        links = saved(small, "small-star")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _are_stars(links: DataFrame) -> bool:
    """Whether no node has two lesser neighbours, or lesser and larger ones."""
    ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty()
