"""Connected components of a graph that no machine holds: alternating stars.

A large-star step ties every larger neighbour of a node to the node's least neighbour, a small-star
step ties the others (Kiveris et al., 2014). Both are a minimum by node and a join, so a node with
very many neighbours is summed before the exchange and its join can be split. Each round ends in a
stored table; rounds grow with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _star(both: DataFrame) -> DataFrame:
    """``(u, v)`` to ``(v, least of u's neighbours and u)``."""
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").select(F.col("v"), F.least("u", "m").alias("m"), "u")


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` to ``(node, component)``: the least node of each component with two nodes or more.

    Loops and repeated edges are allowed; without edges the result is empty.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    sign = None
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.select(F.col("m").alias("u"), "v"))
        large = _star(both).where("v > u").select("v", "m")  # every larger neighbour to the least one
        small = _star(large.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        own = small.select(F.col("u").alias("v"), "m")
        after = materialize(small.select("v", "m").unionByName(own).where("v > m").distinct(), "edges")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if found == sign:
            return after.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(after.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
        now, sign = after, found
