"""Connected components of links, by minimum labels with pointer jumping; no link or label comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import hot_keys, skew_join, written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches.

    Each round gives a node the smallest label among its neighbours and itself, then the label of that label, so chains
    shorten by more than half. A hub may have any share of the links: minima are pre-aggregated, labels joined skew-safe.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = written(edges, "edges")
    hubs = hot_keys(edges, "b")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = skew_join(edges.withColumnRenamed("b", "node"), labels, "node", hot=hubs)
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        joined = written(labels.join(least, "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("up")), "joined")
        jump = joined.select(F.col("node").alias("up"), F.col("up").alias("next"))
        labels = skew_join(joined, jump, "up").select("node", "was", F.least("up", F.coalesce("next", "up")).alias("component"))
        labels = written(labels, "labels")
        if labels.where("was <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
