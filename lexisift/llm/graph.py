"""Distributed union-find over a table of links, as DataFrame joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_staged, staged


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (node long, label long): label is the least node of the component.

    Every round a node takes the least label among its neighbours, then every root hooks onto the
    least label that any of its members saw, and members follow their root (so chains shorten by
    doubling).  Rounds go on until no label changes; each round's labels are a staged table, so the
    lineage stays short and a lost executor costs one round.  Aggregations combine on the map side
    and the joins' large keys can be split, so a node with very many links is no single task's load.
    """
    both = links.where(F.col("a") != F.col("b")).select("a", "b")
    both = staged(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        now = labels.join(seen, "node").select("node", "label", F.least("label", "m").alias("l1"))
        hooks = now.groupBy(F.col("label").alias("l1")).agg(F.min("l1").alias("h"))
        new = now.join(hooks, "l1", "left").select("node", F.least("l1", F.coalesce("h", "l1")).alias("l2"), "label")
        obs = Observation()
        marked = new.observe(obs, F.sum((F.col("l2") != F.col("label")).cast("long")).alias("changed"))
        after = staged(marked.select("node", F.col("l2").alias("label")), "labels")
        drop_staged(labels)
        labels = after
        if not obs.get["changed"]:
            drop_staged(both)
            return labels
