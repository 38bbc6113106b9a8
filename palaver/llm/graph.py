"""Connected components of an edge list, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component: the least node that is reachable. Self-loops and repeats do no harm.

    Each round gives every node the least label of its neighbours and then its label's label, so the number of rounds grows with the
    logarithm of a component's width. Labels are written to the shared folder in each round. A node of very many edges is joined
    (and split, where it is skewed) and summed up on every task, never gathered.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "edges")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("near"))
        better = label.join(near, label.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        target = better.select(F.col("node").alias("_to"), F.col("component").alias("_label"))
        jumped = better.join(target, better.component == target._to).select("node", "old", F.least("component", "_label").alias("component"))
        jumped = materialise(jumped, "labels")
        discard(label)
        label = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            discard(both)
            return label
