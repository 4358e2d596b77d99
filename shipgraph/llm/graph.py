"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)),
                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (long columns a, b): root is the
    component's smallest node.  Each round points neighbours to the smallest
    one nearby, by sums over edges and joins on nodes only (no group is
    gathered); rounds end when no edge changes.  Each round is a written table."""
    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"),
                                            F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.where("b > a").join(least, "a").where("b != m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = stored(large.distinct(), "large")
        # small star: a node's smaller neighbours, and it, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b != m").select(F.col("b").alias("a"),
                                                             F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))))
        e = stored(small.distinct(), "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
