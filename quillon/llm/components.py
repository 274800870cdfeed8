"""Connected components of a table of links, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for each node of ``links``; the component is its smallest node.

    Alternates large-star and small-star steps until nothing changes: each step
    links the neighbours of a node to the smallest of them, so that a component
    becomes a star in a number of rounds that grows with the logarithm of its
    size. A step shuffles one row per link, with the minimum pre-aggregated, so
    that a hub is no single task's list. Each round is written, for its lineage
    to be cut. Links of a node to itself keep the node.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        # Large star: neighbours above a node move to the smallest node around it.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") >= F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below a node, and itself, move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = now
