"""Connected components of a distributed set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuary.session import materialise


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by its smallest node.

    Each round takes the smallest label among a node and its neighbours (summed up inside the map tasks, so a node
    with very many links is no hot group), then jumps to that label's own label. Labels are checkpointed each
    round; it ends when none changes. Links of a node to itself only name the node.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        of_label = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = materialise(
            step.join(of_label, "next", "left").select("node", "label", F.least("next", F.coalesce("jump", "next")).alias("next"))
        )
        changed = not moved.where(F.col("next") != F.col("label")).isEmpty()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
