"""Connected components of an edge table by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the least node of its component.

    Each round takes the least label among the neighbours, then the label of the label; tables are written to the
    shared folder after each round. Joins are on plain keys, so that skewed nodes can be split.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = table = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialise(lower.join(root, "label").select("node", F.least("label", "further").alias("label"), "old"), "labels", instead_of=table)
        table, labels = new, new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return labels
