"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.storage import stored


def _attach(links: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """`links` with `low`, the least node known at `key`. The minima come from storage, so both sides are dealt for the join and a hub's links can be split."""
    return links.join(least.withColumnRenamed("node", "_node"), F.col(key) == F.col("_node")).drop("_node")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, component): every node of a link with the least node that it reaches. Ids are numbers or texts.

    Each round replaces links by links to smaller neighbours, first from larger neighbours (large star), then among
    smaller ones (small star), until each component is a star around its least node: some log of the longest path in
    rounds. A node's links are never gathered: only their minimum is, summed up before the shuffle. Null ids and links
    of a node to itself are passed over. Each round is written to the shared folder, so lost executors cost one round.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low_end")).distinct(), "links")
    known = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low_end"))).first())
        if mark == known or not mark[0]:
            break
        known = mark
        ends = edges.select(F.inline(F.array(F.struct(F.col("low_end").alias("node"), F.col("low_end").alias("other")), F.struct(F.col("high").alias("node"), F.col("low_end").alias("other")))))
        least = stored(ends.groupBy("node").agg(F.min("other").alias("low")), "least")
        large = stored(_attach(edges, "low_end", least).select("high", F.col("low").alias("low_end")).distinct(), "large-star", (edges, least))
        least = stored(large.groupBy(F.col("high").alias("node")).agg(F.min("low_end").alias("low")), "least")
        pairs = F.array(F.struct("high", F.col("low").alias("low_end")), F.struct(F.col("low_end").alias("high"), F.col("low").alias("low_end")))
        edges = stored(_attach(large, "high", least).select(F.inline(pairs)).where("high <> low_end").distinct(), "links", (large, least))
    nodes = edges.select(F.col("high").alias("node"), F.col("low_end").alias("component"))
    return nodes.unionByName(edges.select(F.col("low_end").alias("node"), F.col("low_end").alias("component")).distinct())
