"""Connected components of a link table, by alternating large and small stars; tables in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glossweave.session import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another.

    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours (Kiveris and others, 2014); a
    node's smallest neighbour is an aggregate with partial results and comes back by a join whose other side has one row a
    node, so a node with very many links is split. Rounds end when nothing changes; they grow with the logarithm of the longest
    path. Nulls and links to oneself are ignored; no links: no rows.
    """
    edges = links.filter((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, seen = materialise(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u != v").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
