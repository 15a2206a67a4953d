"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, label for every end of an edge (a, b); label is the smallest node of the component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label. The
    labels are written to the shared folder each round, so the plan does not grow and lost executors cost
    one round. Edges with a null end are ignored; an empty input gives no rows.
    """
    pairs = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = materialize(moved.join(jump, "to").select("node", F.least("to", "further").alias("label"), "was"), "labels")
        changed = new.filter("label <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels
