"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set, summed on the executors."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``: the smallest node it is linked to.

    Each step groups by the smaller end with map-side combining and joins that one row per node
    back, so a node with many links is one hot join key against a single row, which Spark splits.
    Steps end when the edges are stars; each writes its edges, so that no lineage builds up.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = cut_lineage(edges)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m"))
        large = both.join(least, both.a == least.u).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and the node itself, meets the least of them
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        met = large.join(least, large.a == least.u)
        small = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        edges = cut_lineage(small.distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots.join(stars.select("node"), "node", "left_anti"))
