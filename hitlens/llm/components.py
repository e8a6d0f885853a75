"""Connected components of a link table: least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import stage


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node that is in a link; component: its smallest node.

    links: columns a, b of one integer type; loops, repeats and both directions
    may occur, null ends are ignored. A round takes each node's least label
    among its neighbours (an aggregation with map-side combine, so a node of very
    many links is no burden) and then its label's label, which halves long
    chains. Each round is staged: nothing is collected, and lost executors cost
    one round at most. No links: no rows.
    """
    ends = links.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    edges = stage(ends.select(F.col("x.a").alias("node"), F.col("x.b").alias("other")).distinct(), "edges")
    labels = stage(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    for _ in range(rounds):
        offered = edges.join(labels, "node").select(F.col("other").alias("node"), F.col("component"), F.lit(None).cast("long").alias("own"))
        kept = labels.select("node", "component", F.col("component").alias("own"))
        least = offered.unionByName(kept).groupBy("node").agg(F.min("component").alias("component"), F.max("own").alias("own"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        jumped = least.join(jump, "component", "left").select("node", F.least("component", "beyond").alias("component"), "own")
        after = stage(jumped, "labels")
        settled = after.filter("component <> own").isEmpty()
        labels = after.select("node", "component")
        if settled:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
