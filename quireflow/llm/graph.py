"""Connected components of a link table, by smallest label and pointer jumping; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> id, component: the smallest id reachable, for every id that has a link to another.

    Each round takes the smallest label among a node and its neighbours, then the label of that label. Both sums are
    combined before their shuffle and the joins are plain inner joins, so a node with very many links is split.
    """
    both = links.filter("a <> b").select("a", "b").distinct()
    edges = cut(both.union(both.select("b", "a")).distinct())
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    labels = cut(labels)
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        new = cut(lower.join(up, "c").select("id", "old", F.least("c", "up").alias("component")))
        labels = new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            return labels
