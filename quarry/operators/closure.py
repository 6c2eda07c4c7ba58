"""Everything reachable from given nodes, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import durable, written


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)``: nodes reachable over ``edges(source, target)`` from ``starts(node)``, with their least depth.

    Each level joins only the nodes found last; cycles end since known nodes are not followed again. The
    levels are checkpointed in the shared folder. Null nodes are left out; an empty start gives no rows.
    """
    known = level = durable(starts.select("node", F.lit(0).alias("depth")).where(F.col("node").isNotNull()).distinct())
    edges = written(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    depth = 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        found = edges.join(level.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        level = durable(found.join(known.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        known = known.unionByName(level)
    return known
