"""Connected components of an edge table, as iterated joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges`` (a, b: long) with the smallest vertex it can reach.

    Each round takes the smallest label among the neighbours and then the label of
    that label (pointer jumping), so the rounds grow with the logarithm of the
    longest chain. Each round's labels are written, and those of the round before
    dropped. Returns (v, label); vertices without an edge are absent. An empty edge table
    gives an empty result.
    """
    shelf = Shelf(edges.sparkSession, "components")
    both, edge_path = shelf.put(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels, path = shelf.put(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("v", "b"), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("far"))
        new, new_path = shelf.put(lower.join(jump, "low").select("v", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved")))
        shelf.drop(path)
        labels, path = new.select("v", "label"), new_path
        if new.where("moved").isEmpty():
            shelf.drop(edge_path)
            return labels
    raise RuntimeError(f"labels still moved after {max_rounds} rounds")
