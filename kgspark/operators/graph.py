"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has an edge: ``(id, component)``.

    Alternating large-star and small-star steps: each keeps every component connected, never adds
    more edges than it was given plus one per node, and the number of rounds grows with the logarithm of the longest
    path. A hub is never gathered: the minimum of its neighbours is a partial aggregate, and its join is
    one that adaptive execution splits when skewed. Each round ends in a checkpoint. Null ends and self
    loops are ignored; no edges give no rows.
    """
    now = cut(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    before, rows = None, now.count()
    for _ in range(max_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that already is its neighbours' minimum keeps them through its own large-star edges
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = cut(small, 2 * rows)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before, rows = mark, mark[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
