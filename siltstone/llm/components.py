"""Connected components of links in rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


#: A node with more links than this, and than a share of them all that only HUBS nodes can have, is a hub.
HUB, HUBS = 1000, 1000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; nodes without a link are left out.

    Each round every node hands the least node it knows of to the others around it (alternating large-star and small-star), which
    ends in stars about the least nodes after a number of rounds that grows with the logarithm of the longest path.
    Links and nodes stay in tables; the driver sees two sums a round. Null nodes link nothing.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = cut(edges, "links"), None
    count = edges.count()
    while count:
        hub = max(HUB, 2 * count // HUBS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        # large star: each larger neighbour, to the least of all
        large = cut(spread_join(both.where("v > u"), least, ["u"], hub).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        # small star: each smaller neighbour and the node itself, to the least of the smaller ones
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["u"], hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        count = sums[0]
        if sums == before:
            break
        before = sums
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
