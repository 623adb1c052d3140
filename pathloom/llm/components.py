"""Connected components of a link table by alternating star contraction, each round kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is linked to the node's smallest neighbour (or itself)."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v: long); root is the smallest node reached.

    Links only ever move towards smaller nodes, so the sum of their ends falls until the links are
    stars; the sums are compared, nothing is gathered. Self links and repeated links do no harm.
    """
    spark = edges.sparkSession
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now, path = keep(edges.where("u <> v").distinct(), "links")
    was = state(now)
    for _ in range(rounds if was[0] else 0):
        after, new_path = keep(_small_star(_large_star(now)), "links")
        discard(spark, path)
        now, path, seen, was = after, new_path, was, state(after)
        if seen == was:
            break
    else:
        if was[0]:
            raise RuntimeError("links did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
