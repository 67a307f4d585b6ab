"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.skew import HOT_ROWS, hot_keys
from vellum.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``node, component`` for every node of an edge; the component is the smallest node that can be reached.

    Every round each node takes the smallest label among its neighbours and then that label's own label, so a chain of n
    nodes takes about log n rounds. Labels are written to the checkpoint folder after a round; nothing but one count comes
    to the driver. A node with very many neighbours is spread over tasks in the join that brings labels to its edges. Loops and repeated or reversed edges are fine, edges with a null end are left out; no edges, no rows.
    """
    both = edges.where(f"{a} is not null and {b} is not null").select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut_lineage(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    # edges of a node with many neighbours go to several tasks; there is at most one such node for each ``hot_rows`` edges
    hot = cut_lineage(hot_keys(both, ["other"], hot_rows=hot_rows))
    spread = not hot.isEmpty()
    if spread:
        salts = F.coalesce("_salts", F.lit(1))
        both = cut_lineage(both.withColumn("_hk", F.xxhash64("other")).join(F.broadcast(hot), "_hk", "left").withColumn("_salt", F.pmod(F.xxhash64("node"), salts).cast("int")).select("node", "other", "_salt"))
    labels = cut_lineage(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        reach = labels.select(F.col("node").alias("other"), "component")
        if spread:
            reach = reach.withColumn("_hk", F.xxhash64("other")).join(F.broadcast(hot), "_hk", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hk", "_salts")
        near = both.join(reach, ["other", "_salt"] if spread else ["other"]).groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), "was")
        new = cut_lineage(new)
        if new.where("component != was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError("the components did not settle")
