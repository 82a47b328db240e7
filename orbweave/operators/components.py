"""Connected components of an edge list, as rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.session import stage, unstage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component): for every vertex of ``edges(u, v)`` the least vertex of its component.

    Alternates large-star and small-star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): O(log n) rounds in practice, each a partial aggregation for the
    minimum and one join, so that a hub is pre-aggregated before the shuffle and its join
    partition can be split by AQE.  Vertices can have any orderable type.  Self loops name a
    vertex without neighbours.  Each round is staged in the shared folder.
    """
    loops = edges.where("u = v").select(F.col("u").alias("v"), F.col("u").alias("component"))
    # every edge points from the larger to the smaller vertex
    now = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = stage(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            down.select("u", F.col("m").alias("v"))
        )
        after = stage(small.where("u <> v").distinct(), "small")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        unstage(now)
        unstage(large)
        now = after
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError("connected_components did not converge")
    labels = now.select(F.col("u").alias("v"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("v"), F.col("v").alias("component")).distinct()
    return labels.union(roots).union(loops).groupBy("v").agg(F.min("component").alias("component"))
