"""Connected components of links between nodes, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame) -> DataFrame:
    """u, v, m: both directions of every edge, and the least of u and all its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (u, v); root is the component's least node.

    Edges with a null end and loops are ignored; without edges there are no rows.  Rounds go on until nothing changes, which
    takes about as many as the logarithm of the longest chain.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "links")
    while True:
        large = _stars(edges).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where(F.col("u") != F.col("v")).distinct(), "links")
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = large.join(down, F.col("u") == F.col("_u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        small = materialize(small.where(F.col("u") != F.col("v")).distinct(), "links")
        settled = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty() and small.join(small.select(F.col("u").alias("_w")), F.col("v") == F.col("_w"), "left_semi").isEmpty()
        discard(edges, large)
        edges = small
        if settled:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
