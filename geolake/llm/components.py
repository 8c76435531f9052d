"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b), with the smallest id of its component.

    Large-star and small-star steps by turns (Kiveris and others, 2014): edges are rewired to ever smaller neighbours until
    every component is a star around its least id. Each step is an aggregation and a join over edges and is written to
    the shared folder; the number of steps grows with the logarithm of the longest path. No component is gathered, and edges of
    a star's centre are not shuffled by it.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    size = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while size[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("rows"))
        # large star: larger neighbours move to the least one
        least = stored(least, "least")
        large = spread_join(both.where("v > u"), least, "u", "rows", size[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: smaller neighbours move to the least one
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        least = stored(least, "least")
        small = spread_join(large, least, "u", "rows", large.count()).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == tuple(size):
            break
        size = now
    ids = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().join(ids.select("id"), "id", "left_anti"))
