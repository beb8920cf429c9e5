"""Connected components of a link table, as DataFrame jobs.

Large-star / small-star rounds: every node's links move to its smallest
neighbour until each component is a star.  A round works on distinct links,
each written as Parquet in the shared checkpoint folder; the joins read
written tables on both sides, so a hub's rows can be split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.llm.common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns u, v (any order, self links allowed).  Result: node,
    root (the smallest node of its component), for nodes with a link."""
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges)
    state = _state(edges)
    while True:  # each round shortens every path: about log2 of the longest
        # large star: larger neighbours move to the smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct())
        discard(edges, smallest)
        # small star: the smaller neighbours and the node itself move
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u != v").distinct())
        discard(large, least)
        new = _state(edges)
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = new
