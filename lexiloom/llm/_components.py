"""Connected components of an edge table by alternating large and small stars.

Every round is a few shuffles of (node, node) pairs and is written to the shared
folder; the rounds grow with the logarithm of the number of nodes and end when
nothing changes any more. No vertex's neighbours are gathered into one row or
task: minima are map-side combined and written, so that both sides of a join are
plain tables, whose hubs adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, root: the smallest node of each component, for every node that has an edge."""
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state, before = _state(edges), None
    while state[0] and state != before:
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        large = edges.join(least, F.col("v") == F.col("w")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large-star")
        # small star: every smaller neighbour, and the node itself, to the smallest
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small-star")
        state, before = _state(edges), state
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
