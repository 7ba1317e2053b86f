"""Where facts come from: provenance items of fields, graph objects and findings, each with its source references as rows.

References are rows of object_id, document_id, file_hash, page, text_span and are never gathered into one value: a finding
that a third of all events support stays rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.functions.numbers import numbered

#: What makes two references one.
REFERENCE = ["document_id", "file_hash", "page", "text_span"]
FULL_REFERENCE = ["document_id", "filename", "file_hash", "page", "bounding_box", "text_span"]


def field_items(fields: DataFrame) -> DataFrame:
    """An item for each field that is not blank: provenance_id, object_type, object_id, label, status, confidence. fields: document_id, pos, field_name, field_value, confidence."""
    name = F.coalesce(F.nullif(F.col("field_name"), F.lit("")), F.lit("field"))
    ident = F.concat(F.lit("FIELD-"), F.left("document_id", F.lit(8)), numbered("-", F.col("pos"), 4))
    return fields.where(F.trim("field_value") != "").select(
        ident.alias("provenance_id"), F.lit("FIELD").alias("object_type"), F.concat_ws(":", "document_id", name, F.col("pos").cast("string")).alias("object_id"), name.alias("label"), F.lit("OBSERVED").alias("status"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")
    )


def graph_items(nodes: DataFrame, edges: DataFrame, references: DataFrame) -> DataFrame:
    """An item for each node and edge with its number of references. nodes: node_id, kind, label, confidence; edges: edge_id, relationship_type, confidence."""
    counted = references.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_references"))
    item = lambda rows, prefix, kind, ident, label: rows.select(F.concat(F.lit(prefix), ident).alias("provenance_id"), kind.alias("object_type"), F.col(ident).alias("object_id"), F.col(label).alias("label"), "confidence")
    both = item(nodes, "GRAPH-", F.col("kind"), "node_id", "label").unionByName(item(edges, "GRAPH-EDGE-", F.lit("RELATIONSHIP"), "edge_id", "relationship_type"))
    return both.join(counted, "object_id", "left").withColumn("n_references", F.coalesce("n_references", F.lit(0)))


def finding_links(findings: DataFrame, *columns: str) -> DataFrame:
    """finding_id, object_id: the distinct objects that the findings' id columns (arrays of text) name."""
    named = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns))))
    return findings.select("finding_id", F.explode(named).alias("object_id")).where("object_id IS NOT NULL")


def finding_references(links: DataFrame, of_nodes: DataFrame, of_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct references of each finding. An id that is a node (node_id) takes the node's references alone, others those of the edge.

    links: finding_id, object_id, as `finding_links` gives them. Objects are looked up one by one, so a finding with many of them is spread.
    """
    edge_only = of_edges.join(nodes.select(F.col("node_id").alias("object_id")), "object_id", "left_anti")
    known = of_nodes.select("object_id", *REFERENCE).unionByName(edge_only.select("object_id", *REFERENCE))
    return links.join(known, "object_id").select("finding_id", *REFERENCE).distinct()


def unique_references(references: DataFrame) -> DataFrame:
    """References of each object, those equal in all six fields once."""
    return references.select("object_id", *FULL_REFERENCE).distinct()


def relationship_references(relationships: DataFrame, event_references: DataFrame) -> DataFrame:
    """A relationship takes the references of the events at its ends. relationships: id, source_entity, target_entity; event_references by object_id."""
    ends = relationships.select("id", F.explode(F.array("source_entity", "target_entity")).alias("object_id"))
    return ends.join(event_references, "object_id").select(F.col("id").alias("object_id"), *REFERENCE).distinct()


def summary(*items: DataFrame) -> DataFrame:
    """Items by object type, and all of them as TOTAL. Counted before the parts are put together."""
    count = lambda rows: rows.groupBy("object_type").agg(F.count(F.lit(1)).alias("n_items"))
    parts = count(items[0])
    for more in items[1:]:
        parts = parts.unionByName(count(more))
    summed = parts.groupBy("object_type").agg(F.sum("n_items").alias("n_items"))
    return summed.unionByName(parts.agg(F.lit("TOTAL").alias("object_type"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items")))
