"""Connected components of a table of links, by least labels with shortcuts; nothing of the links comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): label is the least node of its component. Links may repeat or join a node to itself.

    Each round takes the least label of a node's neighbours and then the label's own label, so that long chains halve; it ends when no
    label changes. Both sides of every join are tables, so that a node with very many links is split over tasks.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
        low = written(labels.union(near).groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = low.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(low.join(up, "label").select("node", F.least("label", "up").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").where("label != was").limit(1).count()
        if not changed:
            return new
        labels = new
