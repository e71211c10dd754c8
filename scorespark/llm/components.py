"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least_neighbour(links: DataFrame) -> DataFrame:
    """Per node the least node among itself and its neighbours; combined on the map side, so a hub is no hot key."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both_ways(links)
    return (
        both.where("v > u")
        .join(_least_neighbour(both), "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """``links`` (u long, v long; any order, repeats and loops allowed) -> (node, root), root being the least node.

    Only nodes that have a link to another node are returned; null ends are ignored; no links give no rows.
    Each round ends in the shared checkpoint folder. Rounds stop when the link set no longer changes.
    """
    links = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(links)
    while before[0]:
        links = cut(_small_star(_large_star(links)))
        after = state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
