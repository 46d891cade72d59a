"""Connected components by hooking and pointer jumping, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.frames import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the least node of its component.

    Each round, every root hooks to its least neighbouring root, chains are
    shortened by pointer jumping, and edges are rewritten to roots; edges inside a
    component vanish. The number of rounds is logarithmic in the longest chain.
    """
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = settle(
        edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        .withColumn("label", F.col("node")), "labels",
    )
    while not edges.isEmpty():
        hook = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        hook = settle(hook, "hook")
        while True:  # shorten chains: up := up's up
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hop = settle(hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "hop")
            hook = hop.select("node", "up")
            if hop.filter("moved").isEmpty():
                break
        labels = settle(
            labels.join(hook.select(F.col("node").alias("label"), "up"), "label", "left")
            .select("node", F.coalesce("up", "label").alias("label")), "labels",
        )
        ends = hook.select(F.col("node").alias("x"), "up")
        edges = edges.join(ends.withColumnRenamed("x", "a").withColumnRenamed("up", "ua"), "a", "left")
        edges = edges.join(ends.withColumnRenamed("x", "b").withColumnRenamed("up", "ub"), "b", "left")
        edges = edges.select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b"))
        edges = settle(
            edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges"
        )
    return labels
