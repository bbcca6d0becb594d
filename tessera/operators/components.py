"""Connected components of an undirected graph of long node ids, by joins and aggregates only.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"):
every edge points from a larger node to a smaller one.  The large step hangs each node's larger neighbours
on its smallest neighbour, the small step does so with the smaller ones and the node itself.  Rounds grow
with the logarithm of the longest path, whatever the order of the ids, and no step makes more edges than
there were.  Both sides of each join are plain exchanges, so the adaptive plan can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, written


def _large_star(s: Scratch, edges: DataFrame) -> DataFrame:
    """(u, v), u > v -> every neighbour of v larger than v is hung on v's smallest neighbour (v itself counts)."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.withColumnRenamed("v", "at").join(lowest.withColumnRenamed("u", "at"), "at", "left")
    # A node's own edges go to its smallest neighbour too: seen from a smaller neighbour they are in ``moved``.
    return s.written(moved.select("u", F.coalesce("m", "at").alias("v")).distinct(), "large")


def _small_star(s: Scratch, edges: DataFrame) -> DataFrame:
    """(u, v), u > v -> u and all its smaller neighbours are hung on the smallest of them."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
    moved = edges.join(lowest.where("most > m").select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return s.written(moved.union(lowest.select("u", "m")).distinct(), "small")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node id of the component, for every node that has a link (columns a, b)."""
    return components_and_rounds(links)[0]


def components_and_rounds(links: DataFrame) -> tuple[DataFrame, int]:
    spark = links.sparkSession
    with Scratch(spark) as s:
        apart = F.col("a") != F.col("b")
        edges = s.written(links.where(apart).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        rounds = 0
        while True:
            rounds += 1
            large = _large_star(s, edges)
            new = _small_star(s, large)
            # Done once every node has one edge and hangs on a node that has none.
            ends = new.groupBy("u").agg(F.count("*").alias("n")).select("u", "n")
            open_ = new.join(ends.select(F.col("u").alias("v")), "v", "left_semi").limit(1).union(ends.where("n > 1").select("u", "n").limit(1))
            done = open_.isEmpty()
            s.drop(edges, large)
            edges = new
            if done:
                break
        labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
        out = written(labels.union(roots), "labels")
    return out, rounds
