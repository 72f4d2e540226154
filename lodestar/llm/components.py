"""Connected components of a link table, by alternating stars.

Every step gives each node's neighbours the smallest neighbour as their only
link, which halves paths and keeps the number of links; the links stay in
tables, written between the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _finished(links: DataFrame) -> bool:
    """Has every node one link, to a node without any?"""
    own = links.groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    onward = links.join(own.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return own.where("c > 1").select("u").unionByName(onward).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (u, root) for every node with a link that is not itself the smallest of its component.

    Every step takes links to smaller nodes, so the loop ends; it takes about as many steps as paths can be halved.
    """
    now = stored(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _finished(now):
        now = stored(_small(_large(now)), "links")
    return now.select("u", F.col("v").alias("root"))
