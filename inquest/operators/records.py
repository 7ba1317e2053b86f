"""Relational building blocks of the evidence store: latest versions, flattening, remapping, checks of reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, content: str, *order) -> DataFrame:
    """The first row of each distinct content, in this order, with its SHA-256: ingest keeps one document per hash.

    The candidates are reduced to their ids by an aggregation before content is looked at again.
    """
    hashed = rows.withColumn("content_hash", F.sha2(F.col(content), 256))
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("_first"))
    keys = [c if isinstance(c, str) else c._jc.toString() for c in order]
    kept = first.select("content_hash", *(F.col(f"_first.{k}").alias(f"_{k}") for k in keys))
    match = hashed["content_hash"] == kept["content_hash"]
    for k in keys:
        match = match & hashed[k].eqNullSafe(kept[f"_{k}"])
    return hashed.join(kept, match, "left_semi")


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The last version of each key: the first row in this (descending) order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def flattened(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Wide rows as tall ones: key, pos, field_name, field_value. fields: field name by column, in order; null values are left out."""
    items = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(name).alias("field_name"), F.col(c).cast("string").alias("field_value")) for i, (c, name) in enumerate(fields.items())))
    return rows.select(key, F.inline(items)).where("field_value IS NOT NULL")


def low_confidence(rows: DataFrame, confidence: str, threshold: float = 0.85) -> DataFrame:
    """Rows below the review threshold, with a flag code."""
    return rows.where(F.col(confidence) < threshold).withColumn("flag", F.lit("low_confidence_field"))


def remapped(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """`column` replaced by its canonical id where `mapping` (id, canonical_id) has one."""
    renamed = mapping.select(F.col("id").alias("_id"), F.col("canonical_id").alias("_canonical"))
    return rows.join(renamed, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_canonical", column)).drop("_id", "_canonical")


def canonical_ids(entities: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """id, canonical_id: entities with equal keys share the least id. The least ids are summed up before the shuffle and joined back: no group is gathered."""
    least = entities.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min(ident).alias("canonical_id"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return entities.join(least, same).select(F.col(ident).alias("id"), "canonical_id")


def dangling(edges: DataFrame, nodes: DataFrame, end: str, code: str) -> DataFrame:
    """Edges whose `end` is no node: object_id, code. edges: edge_id and the end; nodes: node_id."""
    return edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_anti").select(F.col("edge_id").alias("object_id"), F.lit(code).alias("code"))


def collisions(rows: DataFrame, ident: str, *content: str) -> DataFrame:
    """Ids that rows of different content share."""
    return rows.groupBy(ident).agg(F.count_distinct(F.xxhash64(*content)).alias("n_contents")).where("n_contents > 1")


def merged_members(members: DataFrame, cluster: str) -> DataFrame:
    """Clusters as canonical entities: the least confidence, sorted aliases, types and member ids. members: id, name, type, confidence."""
    sorted_set = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    return members.groupBy(cluster).agg(F.min("confidence").alias("confidence"), sorted_set("name", "aliases"), sorted_set("type", "types"), sorted_set("id", "member_ids"))


def attribute_conflicts(attributes: DataFrame, cluster: str) -> DataFrame:
    """Attributes of merged entities (cluster, key, value): the sorted distinct values of each key, and whether they conflict."""
    held = attributes.where("value IS NOT NULL").groupBy(cluster, "key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return held.withColumn("conflict", F.size("values") > 1)


def first_references(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row in this order for each source reference: an evidence review shows a reference once."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
