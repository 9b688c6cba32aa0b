"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.llm.common import checkpoint


def _star(pairs: DataFrame) -> DataFrame:
    """pairs(u, v): each v and u of a group point at the group's smallest member.

    The smallest member comes from a pre-aggregated groupBy and a join that may be split, so no group, however large,
    has to fit one task."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of any ordered type, to (node, component): component is the smallest node that can be reached.

    Repeated edges, loops and both directions are allowed; nodes without an edge to another node do not appear; an empty
    table gives an empty table; edges with a null end are left out. Each round's edges go to the shared checkpoint
    folder, so lineage stays short and a lost executor costs one round."""
    ends = edges.where(F.col("a") != F.col("b"))
    now = checkpoint(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _star(large.where("u != v"))
        small = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            near.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        now = checkpoint(small.where("a != b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
