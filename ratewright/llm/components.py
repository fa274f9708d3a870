"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``, as a written table; component is the smallest node.

    Both star steps are a grouped minimum and a join, so a hub with millions of
    neighbours never becomes one group's list, and adaptive execution splits its side of
    the join. Rounds grow with the logarithm of
    the longest chain; each round is a written table.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    edges = materialize(links.filter("u <> v").select(*pair).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").select(*pair).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        fresh = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        state = fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = fresh
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    discard(edges)
    return found
