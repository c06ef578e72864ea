"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node hangs on one centre and no centre hangs on another."""
    total = edges.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).first()
    centres = edges.select(F.col("b").alias("a")).distinct()
    return total.n == total.d and edges.join(centres, "a", "left_semi").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` of every node that has an edge; the component is its smallest node.

    ``edges`` has ``a, b bigint``. Work is linear in the edges each round and the rounds are
    logarithmic; every round's edges are written to the shared folder.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = scratch.keep(edges.filter("a <> b").select(a, b).distinct(), "edges")
    while not _is_star_forest(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        nxt = scratch.keep(small.distinct(), "edges")
        scratch.drop(now)
        now = nxt
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)
