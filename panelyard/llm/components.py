"""Connected components by alternating large-star and small-star steps, as joins of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, saved

#: A node with more links is a hub: its lowest neighbour is sent to all tasks, while hubs are few.
HUB_LINKS, BROADCAST_HUBS = 200, 500_000


def _with_lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges (u, v) joined with low (u, m, n) on u. Links of hubs stay where they are, so that no task gets all of one's."""
    hubs = low.filter(F.col("n") > HUB_LINKS).select("u", "m")
    if hubs.isEmpty() or not is_small(hubs, BROADCAST_HUBS):
        return edges.hint("merge").join(low.select("u", "m").hint("merge"), "u")
    known = edges.join(F.broadcast(hubs), "u", "left")
    others = known.filter("m is null").drop("m").hint("merge").join(low.filter(F.col("n") <= HUB_LINKS).select("u", "m").hint("merge"), "u")
    return known.filter("m is not null").unionByName(others)


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) to (node, root): every node of an edge with the smallest node that it can reach.

    Self-links, repeated links and links in both directions are allowed; no links give an empty table. Each round rewrites
    every link towards the smallest known neighbour; the rounds end when nothing changes, after about the logarithm of
    the longest chain. The smallest neighbour of a node is an aggregate with map-side minima; it goes back to the links by
    a join, or, for nodes of very many links, to all tasks.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e, seen = saved(e, "links"), None
    for _ in range(max_rounds):
        # large star: neighbours above u go to u's lowest neighbour, u included
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(_lowest(both).withColumn("m", F.least("u", "m")), "lowest")
        large = _with_lowest(both, low).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        # small star: u and its neighbours below go to the lowest of them
        low = saved(_lowest(large), "lowest")
        small = _with_lowest(large, low)
        down = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if seen == tuple(now):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(now)
    raise RuntimeError("the links did not settle")
