"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.llm.common import stored

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked id with the least id it is connected to.

    Both steps are a minimum for each node, combined before the shuffle, and an
    equi-join with it, so no task ever holds the neighbours of a node at once.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        # Large star: every larger neighbour of a node links to the least one.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "large-star")
        # Small star: a node and its smaller neighbours link to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))
        new = stored(small.distinct(), "small-star")
        # Settled once each node has one parent and no parent has one.
        if new.groupBy("a").count().filter("count > 1").isEmpty() and new.select("a").intersect(new.select(F.col("b").alias("a"))).isEmpty():
            edges = new
            break
        edges = new
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
