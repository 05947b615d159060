"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones; small: the lesser ones and itself) are tied to the least of all of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))  # partial minima first
    out = both.join(least, "a")
    if large:
        out = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = out.filter(F.col("a") != F.col("b"))
    return out if large else out.distinct()  # once a round is enough: a large star makes an edge per edge at most


def connected(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) for each node of the edges (a, b); a component is named by its least node. Nodes without edges aren't listed.

    Works on edges only, a star around a node is spread over tasks; each round is written to the shared folder, so a lost
    executor costs one round at most. Ends when a round changes nothing. ``most`` bounds the number of edges, if known.
    """
    edges = written(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges", most)
    state, n = None, 2 * edges.count()  # a round makes an edge per edge, and one per node at most
    while n:  # the number of rounds grows with the logarithm of the longest path
        edges = written(_starred(_starred(edges, True), False), "edges", n)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == state:
            break
        state = now
    tied = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())
