"""Recursive queries as loops of joins, cut by checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.session import shared


def recurse(start: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 10_000) -> DataFrame:
    """start UNION ALL step(start) UNION ALL ... until a level is empty, or silently after `limit` levels."""
    shared(start.sparkSession)
    out, level = start, start.checkpoint()
    for _ in range(limit):
        level = step(level).checkpoint()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def reach(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes within `depth` steps of the seeds (id) over edges (src, dst) in both directions, with the
    smallest depth. Each level joins only the newest nodes and drops those known before."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    known = front = seeds.select(F.col("id")).distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti").withColumn("depth", F.lit(d))
        known = known.unionByName(front)
    return known
