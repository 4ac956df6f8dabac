"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwise.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, component): the least node reachable, for
    every node that has an edge.

    Every round a node takes the least label among its own and its
    neighbours', and then its label's label, so labels travel over paths in
    steps that double.  Rounds write tables to the checkpoint folder; only
    the number of changes reaches the driver."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
        "node", F.least("node", "near").alias("component")))
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        own = labels.select("node", "component", F.col("component").alias("was"))
        nearer = own.unionByName(offered, allowMissingColumns=True).groupBy("node").agg(
            F.min("component").alias("component"), F.max("was").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved = materialize(nearer.join(up, "component").select(
            "node", "was", F.least("component", "above").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
