"""From a graph contract to the evidence graph: typed nodes and edges, with every problem as an issue row.

entities: id, type, name, confidence; events: id, type, title, source_entity,
target_entity, timestamp columns; relationships: id, source_entity,
target_entity, relationship_type, confidence. clusters (from resolution):
canonical_id, member_ids, aliases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.operators.records import collisions, remapped

ISSUE = ["severity", "code", "object_id"]


class ContractError(ValueError):
    """A contract that a strict reading refuses."""


def _issues(rows: DataFrame, severity: str, code: str, ident: str = "id") -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(ident).cast("string").alias("object_id"))


def contract_issues(entities: DataFrame, events: DataFrame, relationships: DataFrame) -> DataFrame:
    """Duplicate and colliding ids, and ends that do not exist or are no entities: severity, code, object_id."""
    kinds = entities.select("id", F.lit("ENTITY").alias("kind")).unionByName(events.select("id", F.lit("EVENT").alias("kind")))
    counted = kinds.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("k"))
    known = kinds.groupBy(F.col("id").alias("end_id")).agg(F.min("kind").alias("end_kind"))
    found = [
        _issues(counted.where("n > 1 AND k = 1"), "error", "DUPLICATE_NODE_ID"),
        _issues(counted.where("k > 1"), "error", "NODE_ID_COLLISION"),
        _issues(relationships.groupBy("id").count().where("count > 1"), "error", "DUPLICATE_RELATIONSHIP_ID"),
    ]
    for side, word in (("source_entity", "SOURCE"), ("target_entity", "TARGET")):
        met = events.where(f"{side} IS NOT NULL AND {side} <> ''").join(known, F.col(side) == F.col("end_id"), "left")
        found.append(_issues(met.where("end_kind IS NULL"), "error", f"DANGLING_EVENT_{word}"))
        found.append(_issues(met.where("end_kind = 'EVENT'"), "error", f"INVALID_EVENT_{word}_KIND"))
        lost = relationships.join(known, F.col(side) == F.col("end_id"), "left_anti")
        found.append(_issues(lost, "error", f"DANGLING_{word}_ENDPOINT"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def adapt(entities: DataFrame, events: DataFrame, relationships: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, events, the relationships with both ends, and the issues; strict: raise if there are any errors."""
    issues = contract_issues(entities, events, relationships)
    if strict and (some := [r.asDict() for r in issues.where("severity = 'error'").limit(5).collect()]):
        raise ContractError("; ".join(f"{r['code']} {r['object_id']}" for r in some))
    ids = entities.select("id").unionByName(events.select("id"))
    kept = relationships
    for side in ("source_entity", "target_entity"):
        kept = kept.join(ids.select(F.col("id").alias(side)).distinct(), side, "left_semi")
    return entities, events, kept, issues


def merge_map(clusters: DataFrame) -> DataFrame:
    """id, canonical_id of clustered entities."""
    return clusters.select(F.explode("member_ids").alias("id"), "canonical_id")


def build(entities: DataFrame, events: DataFrame, relationships: DataFrame, clusters: DataFrame | None = None, raise_dangling: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and issues of the evidence graph.

    Clustered entities become one node: the least confidence, all names as aliases. Ends of events and relationships follow.
    Relationships that then join a node with itself are dropped with a warning; dangling ones with an issue, or an error.
    One id with different contents raises.
    """
    mapping = merge_map(clusters) if clusters is not None else None
    move = lambda rows, c: remapped(rows, c, mapping) if mapping is not None else rows
    moved = move(entities.withColumn("node_id", F.col("id")), "node_id")
    people = moved.groupBy("node_id").agg(
        F.lit("ENTITY").alias("kind"), F.max_by("type", F.col("id") == F.col("node_id")).alias("type"), F.max_by("name", F.col("id") == F.col("node_id")).alias("label"),
        F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("name")).alias("aliases"), F.array_sort(F.collect_set("id")).alias("member_ids"),
    )
    told = move(move(events, "source_entity"), "target_entity")
    happened = told.select(F.col("id").alias("node_id"), F.lit("EVENT").alias("kind"), "type", F.col("title").alias("label"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("aliases"), F.array("id").alias("member_ids"), "source_entity", "target_entity")
    for rows, ident, content in ((entities, "id", ("type", "name")), (events, "id", ("type", "title", "source_entity", "target_entity")), (relationships, "id", ("source_entity", "target_entity", "relationship_type"))):
        if twice := collisions(rows, ident, *content).limit(5).collect():
            raise ContractError("NODE_COLLISION or EDGE_COLLISION: " + ", ".join(str(r[ident]) for r in twice))
    nodes = people.unionByName(happened, allowMissingColumns=True).dropDuplicates(["node_id"])
    linked = move(move(relationships, "source_entity"), "target_entity").dropDuplicates(["id"])
    ids = nodes.select("node_id")
    whole = linked
    for side in ("source_entity", "target_entity"):
        whole = whole.join(ids.select(F.col("node_id").alias(side)), side, "left_semi")
    lost = linked.join(whole.select("id"), "id", "left_anti")
    if raise_dangling and (some := lost.limit(5).collect()):
        raise ContractError("DANGLING_RELATIONSHIP: " + ", ".join(str(r["id"]) for r in some))
    issues = _issues(lost, "error", "DANGLING_RELATIONSHIP").unionByName(_issues(whole.where("source_entity = target_entity"), "warning", "COLLAPSED_SELF_RELATIONSHIP"))
    edges = whole.where("source_entity <> target_entity").select(F.col("id").alias("edge_id"), F.col("source_entity").alias("source_id"), F.col("target_entity").alias("target_id"), "relationship_type", "confidence")
    return nodes, edges, issues


def to_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as records: kind (node or edge), id, record (JSON of all columns, nulls too)."""
    whole = lambda rows, kind, ident: rows.select(F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    return whole(nodes, "node", "node_id").unionByName(whole(edges, "edge", "edge_id"))
