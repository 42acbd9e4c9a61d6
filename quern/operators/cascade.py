"""Greedy leader clusters as repeated set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import cut


def leaders(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sig, leader, is_new): each item's leader as a fold over the items in their order (column at) would have it.

    An item joins the earliest leader that it is paired with, and leads a new cluster if there is none. Each round
    settles all items whose earlier partners are settled: those without an earlier leader among them become leaders.
    The number of rounds is the longest chain of earlier partners, not the number of items.
    """
    both = pairs.select(F.col("a").alias("sig"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    order = items.select(F.col("sig").alias("other"), F.col("at").alias("other_at"))
    earlier = cut(both.join(items.select("sig", "at"), "sig").join(order, "other").where("other_at < at").select("sig", "other", "other_at"))
    free = items.select("sig").join(earlier.select("sig").distinct(), "sig", "left_anti")
    done = free.select("sig", F.col("sig").alias("leader"))
    left = cut(items.select("sig").join(free, "sig", "left_anti"))
    done = cut(done)
    while not left.isEmpty():
        waits = earlier.join(left, "sig").join(done.select(F.col("sig").alias("other"), "leader"), "other", "left")
        state = waits.groupBy("sig").agg(
            F.count_if(F.col("leader").isNull()).alias("open"), F.min(F.when(F.col("leader") == F.col("other"), F.struct("other_at", "other"))).alias("lead"),
            F.min(F.when(F.col("leader").isNull(), F.col("other_at"))).alias("open_at"),
        )
        # settled if nothing earlier is open, or if a leader lies before whatever is
        ready = state.where("open = 0 or lead.other_at < open_at").select("sig", F.coalesce("lead.other", "sig").alias("leader"))
        ready = cut(ready)
        done = cut(done.union(ready))
        left = cut(left.join(ready, "sig", "left_anti"))
    return done.select("sig", "leader", (F.col("sig") == F.col("leader")).alias("is_new"))
