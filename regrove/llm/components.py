"""Connected components by alternating large and small stars; nothing but a count of edges reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import MADE, forget, written


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; pre-aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the least node it is linked to, itself included.

    Self-links and repeated or reversed links change nothing; nulls are left out. Each round writes the edges to the shared folder. No
    edges: no rows. The number of rounds grows with the logarithm of the number of nodes.
    """
    since, spark = len(MADE), edges.sparkSession
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large  # u > v throughout
        small = down.join(_least(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(_least(down).select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        forget(spark, since, edges)
        since = len(MADE) - 1
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == was:
            break
        was = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select("v", "v")).distinct()
