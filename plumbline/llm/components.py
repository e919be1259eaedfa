"""Connected components of a distributed edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (pre-aggregated before its shuffle) joined back
to the edges. Nodes with many edges, of which there can be only a few, get their
minimum by a broadcast, so the centre of a star is no task of its own. Each round
is written to the shared folder, which cuts lineage; rounds no longer read are
deleted. Neither edges nor components reach the driver, only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import delete, written

#: A node with more than one in so many of all edges, and more than HUB_EDGES, is a hub: there are at most so many.
HUBS, HUB_EDGES = 500, 500


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """(a, b, m) for each of ``edges``, n rows: m is the least b of a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    most = max(HUB_EDGES, n // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", F.col("m").alias("hub_m")))  # at most HUBS rows
    split = edges.join(hubs, "a", "left")
    rest = split.where("hub_m IS NULL").select("a", "b").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return rest.union(split.where("hub_m IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")))


def components(edges: DataFrame, root: str, name: str) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node it is connected with.

    Loops and repeated edges are allowed. Roots themselves are listed too. Needs no
    more than a number of rounds that grows with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, root, f"{name}-0")
    state, turn = _state(edges), 0
    while state[0]:
        turn += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = written(large, root, f"{name}-{turn}-large")
        small = _with_least(large, large.count())
        edges = written(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), root, f"{name}-{turn}")
        delete(spark, f"{root}/{name}-{turn - 1}")
        delete(spark, f"{root}/{name}-{turn}-large")
        new = _state(edges)
        if new == state:
            break
        state = new
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
