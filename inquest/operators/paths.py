"""Walks over an undirected graph of pairs: hops, shortest paths. Each step is a join with the frontier, written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.operators.numbering import positions
from inquest.operators.projection import both_ways
from inquest.storage import stored


def hops(pairs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within `depth` steps (1 to 10) of the seeds (node_id), with the least number of steps."""
    if not 1 <= depth <= 10:
        raise ValueError("depth must be 1 to 10")
    ways = both_ways(pairs)
    reached = frontier = stored(seeds.select("node_id", F.lit(0).alias("hop")).distinct(), "hop")
    for step in range(1, depth + 1):
        near = frontier.select("node_id").join(ways, "node_id").select(F.col("neighbor_id").alias("node_id")).distinct()
        frontier = stored(near.join(reached, "node_id", "left_anti").select("node_id", F.lit(step).alias("hop")), "hop")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def induced(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with both ends among the nodes."""
    for end in ("src", "dst"):
        pairs = pairs.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return pairs


def search(pairs: DataFrame, source: str, target: str | None = None) -> DataFrame:
    """Breadth-first search from a node: node_id, distance, parent (of the earliest visited neighbour, as a queue over sorted neighbours visits them)."""
    spark, ways = pairs.sparkSession, both_ways(pairs)
    first = spark.createDataFrame([(source, 0, None, 1)], "node_id string, distance int, parent string, visit long")
    reached = frontier = stored(first, "search")
    step = 0
    while True:
        step += 1
        met = frontier.select(F.col("node_id").alias("parent"), "visit").join(ways, F.col("parent") == F.col("node_id")).select(F.col("neighbor_id").alias("node_id"), "parent", "visit")
        new = met.join(reached.select("node_id"), "node_id", "left_anti").groupBy("node_id").agg(F.min(F.struct("visit", "parent")).alias("by"))
        # Visits follow the parent's visit, then the id.
        ranked = new.select("node_id", F.lit(step).alias("distance"), F.col("by.parent").alias("parent"), F.col("by.visit").alias("visit_of"))
        placed = positions(ranked, "visit_of", "node_id", name="visit").select("node_id", "distance", "parent", "visit")
        frontier = stored(placed, "search")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if target is not None and not frontier.where(F.col("node_id") == target).isEmpty():
            break
    return reached.drop("visit")


def shortest_path(pairs: DataFrame, source: str, target: str) -> list[str]:
    """Node ids from source to target, empty if there is no way: of the shortest ways, the one that a queue finds first."""
    if source == target:
        return [source]
    found = stored(search(pairs, source, target), "paths")
    end = found.where(F.col("node_id") == target).select("distance").first()
    if end is None:
        return []
    # Back along the parents: each round doubles the steps, so a long way takes few rounds.
    way = pairs.sparkSession.createDataFrame([(target, 0)], "node_id string, step int")
    jump, step = found.where("parent is not null").select("node_id", "parent"), 1
    while step <= end.distance:
        way = stored(way.unionByName(way.join(jump, "node_id").select(F.col("parent").alias("node_id"), (F.col("step") + step).alias("step"))), "way")
        step *= 2
        if step <= end.distance:
            jump = stored(jump.join(jump.select(F.col("node_id").alias("parent"), F.col("parent").alias("up")), "parent").select("node_id", F.col("up").alias("parent")), "jumps")
    return [r.node_id for r in sorted(way.collect(), key=lambda r: -r.step)]


def path_support(pairs: DataFrame, path: list[str]) -> DataFrame:
    """The pairs along a path in order, with their supporting ids: step, src, dst, relationship_ids, event_ids."""
    rows = [(i, *sorted(p)) for i, p in enumerate(zip(path, path[1:]), 1)]
    steps = pairs.sparkSession.createDataFrame(rows, "step int, src string, dst string")
    return F.broadcast(steps).join(pairs, ["src", "dst"]).orderBy("step")  # as many rows as the path has steps


def evidence_links(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs (src, dst) of the whole evidence graph: edges, and events joined to the entities at their ends."""
    ends = F.explode(F.array_compact(F.array("source_entity_id", "target_entity_id")))
    of_events = events.select(F.col("event_id").cast("string").alias("src"), ends.alias("dst"))
    return edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).unionByName(of_events).where("src <> dst").distinct()
