"""Temporal queries over events: windows, snapshots, deltas, activity buckets.

Events are rows of event_id, start_at, end_at, source_entity_id, target_entity_id
(either may be null); edges rows of edge_id, source_id, target_id, start_at,
end_at (null: undated). Windows include both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions.numbers import ordered_pair
from inquest.functions.times import bucket, interval


def when(text: str) -> Column:
    """An instant from text."""
    return F.to_timestamp(F.lit(text))


def dated_events(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event nodes (id, type, attributes) -> events with times, and issues INVALID_EVENT_TIME and UNDATED_EVENT as (object_id, code)."""
    held = nodes.withColumn("when", interval(F.col("attributes")))
    ends = [F.nullif(F.try_element_at("attributes", F.lit(k)), F.lit("")).alias(k) for k in ("source_entity_id", "target_entity_id")]
    events = held.where("when.start IS NOT NULL").select(F.col("id").alias("event_id"), F.col("type").alias("event_type"), F.col("when.start").alias("start_at"), F.col("when.stop").alias("end_at"), *ends)
    code = F.when(~F.col("when.dated"), "UNDATED_EVENT").when(F.col("when.problem"), "INVALID_EVENT_TIME")
    return events, held.select(F.col("id").alias("object_id"), code.alias("code")).where("code IS NOT NULL")


def in_window(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Rows whose time overlaps the window: a pair of range predicates that a Parquet scan can use."""
    return rows.where((F.col("start_at") <= stop) & (F.col("end_at") >= start))


def entities(events: DataFrame, *keep: str) -> DataFrame:
    """A row for each event and distinct entity at its ends: entity_id and the columns to keep."""
    ends = F.array_distinct(F.array_compact(F.array("source_entity_id", "target_entity_id")))
    return events.select(*keep, F.explode(ends).alias("entity_id"))


def active_entities(events: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Distinct entities with an event in the window."""
    return entities(in_window(events, start, stop)).distinct()


def activity_buckets(events: DataFrame, start: Column, stop: Column, minutes: int = 60) -> DataFrame:
    """Events per entity and bucket: an event counts in every bucket that its time, clipped to the window, touches."""
    seen = in_window(events, start, stop)
    low, high = bucket(F.greatest("start_at", start), minutes), bucket(F.least("end_at", stop), minutes)
    spread = seen.withColumn("bucket_start", F.explode(F.sequence(low, high, F.expr(f"INTERVAL {minutes} MINUTES"))))
    return entities(spread, "bucket_start").groupBy("entity_id", "bucket_start").agg(F.count(F.lit(1)).alias("event_count"))


def snapshot_edges(events: DataFrame, edges: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Edges in a snapshot: dated ones that overlap the window, and those that touch an event in it. Undated ones get no date."""
    ids = in_window(events, start, stop).select(F.col("event_id").cast("string").alias("event_id"))
    near = edges.select("edge_id", F.explode(F.array("source_id", "target_id")).alias("event_id")).join(ids, "event_id", "left_semi").select("edge_id")
    return in_window(edges, start, stop).select("edge_id").unionByName(near).distinct()


def snapshot_nodes(events: DataFrame, edges: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Nodes in a snapshot: events in the window, their entities, and the ends of the snapshot's edges."""
    seen = in_window(events, start, stop)
    ends = edges.join(snapshot_edges(events, edges, start, stop), "edge_id", "left_semi")
    parts = [seen.select(F.col("event_id").cast("string").alias("node_id")), entities(seen).select(F.col("entity_id").cast("string").alias("node_id"))]
    parts.append(ends.select(F.explode(F.array("source_id", "target_id")).alias("node_id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def active_pairs(edges: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Undirected pairs with a dated edge in the window."""
    return in_window(edges, start, stop).select(*ordered_pair("source_id", "target_id")).distinct()


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that came (NEW) or went (GONE) between two snapshots of the same columns: one aggregation of both."""
    both = before.distinct().withColumn("seen", F.lit(1)).unionByName(after.distinct().withColumn("seen", F.lit(2)))
    changes = both.groupBy(*before.columns).agg(F.sum("seen").alias("seen")).where("seen < 3")
    return changes.select(*before.columns, F.when(F.col("seen") == 2, "NEW").otherwise("GONE").alias("change"))


def snapshot_changes(events: DataFrame, edges: DataFrame, before: tuple[Column, Column], after: tuple[Column, Column]) -> DataFrame:
    """All that came or went between two windows: kind (NODE, EDGE, PAIR), object_id (of a pair its two ids), change (NEW, GONE)."""

    def seen(start: Column, stop: Column) -> DataFrame:
        of = lambda rows, kind, ident: rows.select(F.lit(kind).alias("kind"), ident.alias("object_id"))
        nodes, links = snapshot_nodes(events, edges, start, stop), snapshot_edges(events, edges, start, stop)
        pairs = of(active_pairs(edges, start, stop), "PAIR", F.concat_ws(" ", "src", "dst"))
        return of(nodes, "NODE", F.col("node_id").cast("string")).unionByName(of(links, "EDGE", F.col("edge_id").cast("string"))).unionByName(pairs)

    return delta(seen(*before), seen(*after))


def snapshot_counts(events: DataFrame, edges: DataFrame, start: Column, stop: Column) -> DataFrame:
    """One row about a snapshot: its events, entities, edges with a date and without one, and pairs."""
    kept = edges.join(snapshot_edges(events, edges, start, stop), "edge_id", "left_semi")
    of_edges = kept.agg(F.count("start_at").alias("n_dated_edges"), F.count_if(F.col("start_at").isNull()).alias("n_undated_edges"))
    of_events = in_window(events, start, stop).agg(F.count(F.lit(1)).alias("n_events"))
    of_entities = active_entities(events, start, stop).agg(F.count(F.lit(1)).alias("n_entities"))
    of_pairs = active_pairs(edges, start, stop).agg(F.count(F.lit(1)).alias("n_pairs"))
    return of_events.crossJoin(of_entities).crossJoin(of_edges).crossJoin(of_pairs)  # each has one row
