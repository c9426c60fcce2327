"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import kept


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of the links (a, b) reaches, both being longs.

    Classes hook onto their smallest neighbouring class and pointers are shortened, until no link joins
    two classes. Every round is written to the shared folder; only counts come to the driver.
    """
    edges = kept(links.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = kept(nodes.withColumn("comp", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("low"))
        hooks = kept(least.select("from", F.least("from", "low").alias("to")), "hooks")
        for _ in range(3):
            after = hooks.select(F.col("from").alias("to"), F.col("to").alias("far"))
            hooks = hooks.join(after, "to").select("from", F.col("far").alias("to"))
        hooks = kept(hooks, "hooks")
        moved = labels.join(hooks, labels.comp == hooks["from"], "left")
        labels = kept(moved.select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        one = edges.join(hooks, edges.a == hooks["from"]).select(F.col("to").alias("a"), "b")
        two = one.join(hooks, one.b == hooks["from"]).select("a", F.col("to").alias("b"))
        edges = kept(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    return labels
