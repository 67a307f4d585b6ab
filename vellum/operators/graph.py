"""Bounded breadth-first walks over a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import cut_lineage


def reachable(links: DataFrame, starts: DataFrame, source: str = "src", target: str = "dst", depth: int = 2) -> DataFrame:
    """``node, depth`` for every node within ``depth`` steps of the nodes in ``starts`` (column ``node``), at its least depth.

    One join a level; nodes seen before are taken out by an anti-join, so cycles end. No starts, no rows.
    """
    seen = cut_lineage(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    edge = front = seen
    for level in range(1, depth + 1):
        front = edge.join(links.select(F.col(source).alias("node"), F.col(target).alias("next")), "node").select(F.col("next").alias("node")).where("node is not null").distinct()
        front = cut_lineage(front.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)))
        seen, edge = seen.unionByName(front), front
    return seen
