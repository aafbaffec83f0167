"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.functions.spread import spread_left_join
from specmill.session import settled


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b); the component is its least node.

    Every round each node takes the least label among itself and its neighbours and
    then its label's label, so distances shrink fast. Aggregates combine before the
    shuffle and lookups spread hot labels and hubs over lanes; every round is written out, so the
    lineage stays short and survives lost executors.
    """
    both = (
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    both = settled(both, "edges")
    labels = settled(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")),
        "labels",
    )
    while True:
        seen = labels.select(F.col("node").alias("a"), F.col("component").alias("_near"))
        nearest = (
            spread_left_join(both, seen, "a", F.col("b"))
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("_near").alias("_near"))
        )
        lowered = labels.join(nearest, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("component")
        )
        parents = labels.select(
            F.col("node").alias("component"), F.col("component").alias("_parent")
        )
        jumped = spread_left_join(lowered, parents, "component", F.col("node")).select(
            "node", "_old", F.least("component", "_parent").alias("component")
        )
        jumped = settled(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where(F.col("_old") != F.col("component")).isEmpty():
            return labels
