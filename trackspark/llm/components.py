"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of long ids -> (node, component): the smallest id that each node reaches.

    Every round is two aggregations and joins over the edges; no neighbourhood is gathered anywhere. Null
    ends and loops are ignored; repeated edges are harmless; no edges give no rows. The result is stored.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        # large star: each node's larger neighbours move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours, and itself, move there too
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
    discard(edges)
    return found


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node that has none."""
    several = edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi")
    return several.isEmpty() and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
