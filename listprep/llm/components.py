"""Connected components of a graph given by its edges, as Spark joins and aggregates.

Every round links the larger neighbours of each node to its smallest one (large star), then
the smaller ones (small star), until nothing changes; the paths shorten by a constant factor a
round. A node of many edges is reduced before the shuffle in the aggregate and spread over
tasks by the join, so that no task holds all neighbours of a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mark).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.filter("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that is not the
    smallest of its own; ``edges`` has long columns ``u`` and ``v``. Nulls link nothing."""
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = edges.filter("u <> v").select(larger, smaller).distinct()
    now = materialise(now, "edges")
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
