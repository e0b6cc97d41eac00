"""Connected components of a graph whose links are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import join_names, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node with a link; component is its smallest reachable node.

    Alternates the large-star and small-star steps: each node hands its larger, then its smaller
    neighbours to the smallest one it knows. Only minima by node are computed and no node's
    neighbours are collected; nodes with very many links get their minimum by broadcast. Each round is a
    written table. Rounds go on until the links stay as they are. ``links`` has columns u and v.
    """
    edges = materialize(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_names(both.filter("v > u"), least, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # after the large star each pair is (larger, smaller)
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        turned = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = join_names(large, small_least, "u", n).select(F.explode(turned).alias("e")).select("e.*").filter("u != v").distinct()
        edges = materialize(small, "star")
        # u to v are now links down; done when two rounds give the same links
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state, n = tuple(now), now[0]
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)
