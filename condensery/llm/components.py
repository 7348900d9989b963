"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, written_ids


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for every id of ``edges`` (a, b): root is the smallest id of its component.

    Each round is two shuffles of the edges; their number falls with the logarithm of the longest chain. No node's neighbours
    are ever collected: minima are aggregates and go back by a join, whose hot keys AQE can split.
    """
    e = written_ids(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        # Repeats may stay until the end of the round: neither step makes more edges than it gets, but for one a node.
        large = both.join(low, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(down, F.col("u") == F.col("_u"))
        after = small.select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()
        after = written_ids(after, "edges")
        # Stars: nobody is both above and below, or below two others.
        ends = after.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(after.select("v", F.lit(0), F.lit(1)))
        done = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 0 AND up + down > 1").agg(F.count(F.lit(1))).first()[0] == 0
        forget(e)
        e = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
