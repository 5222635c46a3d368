"""Connected components of a table of links, in DataFrames: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, hot_rows, join_hot, save


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """links: (a, b). Returns (node, comp), comp the smallest node of the component; nodes without links are absent.

    start: (node, comp) of earlier links, all of which are still among these; their labels are taken up.
    """
    edges = save(links.select("a", "b").union(links.select("b", "a")).distinct().select("a", F.col("b").alias("node")), "edges")
    labels = edges.groupBy("node").agg(F.count("*").alias("n"), F.least(F.min("a"), F.first("node")).alias("comp"))
    if start is not None:
        labels = labels.join(start.select("node", F.col("comp").alias("had")), "node", "left").select("node", "n", F.least("comp", F.coalesce("had", "comp")).alias("comp"))
    labels = save(labels, "labels")
    hot = hot_rows(labels, "node")  # the centres of large stars
    while True:
        near = join_hot(edges, labels, "node", hot=hot).groupBy("a").agg(F.min("comp").alias("seen"))
        step = labels.join(near, labels.node == near.a, "left").select(
            "node", "n", F.col("comp").alias("old"), F.least("comp", F.coalesce("seen", "comp")).alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("beyond"))
        after = save(step.join(jump, "mid", "left").select(
            "node", "n", "old", F.least("mid", F.coalesce("beyond", "mid")).alias("comp")), "labels")
        drop(labels)
        labels = after
        if after.where(F.col("old") != F.col("comp")).isEmpty():
            drop(edges, hot)
            return labels.select("node", "comp")
