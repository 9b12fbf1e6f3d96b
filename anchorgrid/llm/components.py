"""Connected components of a link table by alternating stars; no neighbour list is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorgrid.llm.common import stash


def is_stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct ``edges`` (u, v) has one v only and none of these is a u itself."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); the component is its smallest node.

    Every round hangs the larger neighbours of a node onto its smallest one, then the smaller ones; the rounds grow with the
    logarithm of the longest path and end once every edge leads to a root. Minima are pre-aggregated and the joins can be split, so a node may have any number of
    links. Self links and repeated links do no harm; nodes without a link are not returned.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # one row for each edge at most; repeated ones go in the second half
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stash(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = F.explode(F.array("u", "v")).alias("u")
        small = large.join(least, "u").select(hung, F.col("m").alias("v"))
        edges = stash(small.where("u <> v").distinct(), "stars")
        if is_stars(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
