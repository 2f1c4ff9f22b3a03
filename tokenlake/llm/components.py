"""Connected components by alternating large and small stars, as DataFrame joins.

Each round points every node at the smallest node it can see; labels travel along both directions of
an edge, so the rounds grow with the logarithm of the longest path. A node with very many neighbours
is no group of its own anywhere: the minima are partial aggregates and the joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return met.filter("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points at one other node at most and no node that points is pointed at."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    per_node = ends.groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    return per_node.filter("n > 1 OR n = 1 AND least = 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), null ends and loops left out.

    ``component`` is the smallest node. A node that has no edge to another node is not listed.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(down.filter("u <> v").distinct(), "cc")
    while not _are_stars(edges):
        edges = written(_small_star(_large_star(edges)), "cc")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
