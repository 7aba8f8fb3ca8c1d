"""Connected components of a table of links, as a loop of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable from each linked node.

    ``links`` has columns a and b of one type.  Every round takes the smallest
    label among a node and its neighbours and then follows labels once, so
    the number of rounds grows with the logarithm of a component's width.
    Tables are cut by checkpoints; the driver only learns how many labels
    changed.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "m").alias("m"))
        follow = lower.select(F.col("node").alias("at"), F.col("m").alias("to"))
        new = cut(lower.join(follow, F.col("m") == F.col("at")).select("node", F.least("m", "to").alias("component"), (F.least("m", "to") != F.col("component")).alias("changed")))
        labels = new.select("node", "component")
        if not new.where("changed").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
