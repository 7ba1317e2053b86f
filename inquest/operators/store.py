"""The record store as append-only tables: a change is a new version, reads take the latest one, originals stay.

Appends go through Spark's writers; nothing is updated in place, so a write that is repeated after a lost executor leaves
the committed files of one attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.functions.text import key_form


class NotFound(KeyError):
    """No record of this id."""


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of the store."""
    rows.write.mode("append").parquet(path)


def latest(versions: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest version of each record by these columns. Aggregated before the shuffle: a record with very many versions is no single task's list."""
    rest = [c for c in versions.columns if c != key]
    newest = versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest"))
    return newest.select(key, "_newest.*").select(*versions.columns)


def updated(versions: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """New versions of the records that `changes` (key, version and changed columns) names: unchanged columns are those of the latest version.

    A null in `changes` leaves a column as it was. Columns that are to become null are named in `cleared`, an array of names.
    """
    now = latest(versions, key, version)
    changed = [c for c in changes.columns if c not in (key, version, "cleared")]
    emptied = F.coalesce("cleared", F.array().cast("array<string>")) if "cleared" in changes.columns else F.array().cast("array<string>")
    new = changes.select(key, F.col(version).alias("_version"), emptied.alias("_cleared"), *(F.col(c).alias(f"_{c}") for c in changed))
    kept = lambda c: F.coalesce(f"_{c}", c) if c in changed else F.col(c)
    value = lambda c: F.col("_version") if c == version else F.col(c) if c == key else F.when(~F.array_contains("_cleared", F.lit(c)), kept(c))
    return now.join(new, key).select(*(value(c).alias(c) for c in versions.columns))


def reviewed(fields: DataFrame, reviews: DataFrame, key: list[str]) -> DataFrame:
    """Fields with their latest review: original_value stays, field_value is the reviewed one. reviews: key, reviewed_at, new_value, status."""
    last = reviews.groupBy(*key).agg(F.max_by(F.struct("new_value", "status"), F.struct("reviewed_at", "new_value")).alias("_review"))
    seen = fields.withColumnRenamed("field_value", "original_value").join(last, key, "left")
    return seen.select(*key, "original_value", F.coalesce("_review.new_value", "original_value").alias("field_value"), F.coalesce("_review.status", F.lit("PENDING")).alias("review_status"))


def by_id(rows: DataFrame, column: str, ident) -> DataFrame:
    """The rows of one id; NotFound if there is none. The filter reaches the scan."""
    found = rows.where(F.col(column) == ident)
    if found.isEmpty():
        raise NotFound(ident)
    return found


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Records with their child rows as an array in order (empty if there are none): for children that belong to one record, such as a document's fields."""
    held = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in children.columns if c not in (key, *order))))).alias("_children"))
    joined = parents.join(held, key, "left")
    kind = held.schema["_children"].dataType.simpleString()
    return joined.withColumn(name, F.coalesce("_children", F.array().cast(kind))).drop("_children")


def batch_rows(batches: DataFrame, documents: DataFrame, items: DataFrame, batch: str, document: str) -> DataFrame:
    """Batches with their documents and those's items as rows, empty batches and documents too. A batch may hold very many documents, hence rows, not a nest."""
    return batches.join(documents, batch, "left").join(items, document, "left")


def with_latest_child(documents: DataFrame, extractions: DataFrame, key: str, *order: str) -> DataFrame:
    """Flat document rows with the latest extraction as one struct, null if there is none."""
    rest = [c for c in extractions.columns if c != key]
    last = extractions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("latest_extraction"))
    return documents.join(last, key, "left")


def case_scan(documents: DataFrame, case: str, ident: str, *order: str) -> DataFrame:
    """Documents of one case in order of ingest."""
    return documents.where(F.col(case) == ident).orderBy(*order)


def linked_duplicates(arrivals: DataFrame, content_hash: str, ident: str) -> DataFrame:
    """Arrivals whose content the store already has: ident, original_id (the least id of that content). They are linked, not stored again."""
    first = arrivals.groupBy(content_hash).agg(F.min(ident).alias("original_id"))
    return arrivals.select(ident, content_hash).join(first, content_hash).where(F.col(ident) != F.col("original_id")).select(ident, "original_id")


def audit(rows: DataFrame, action: str, at: str, ident: str, detail=None) -> DataFrame:
    """Audit rows for what was done: at, action, object_id, detail."""
    return rows.select(F.col(at).alias("at"), F.lit(action).alias("action"), F.col(ident).cast("string").alias("object_id"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


# Beginnings of a field's name and the group that a reader sees it under.
CATEGORIES = (("party:", "parties"), ("date:", "dates"), ("amount:", "amounts"), ("id:", "identifiers"), ("rule:", "rules"))


def field_search(fields: DataFrame, text: str = "", category: str | None = None) -> DataFrame:
    """Fields with their category, those whose name or value holds the text (whatever its case) and that lie in the category."""
    chain = F
    for start, group in CATEGORIES:
        chain = chain.when(F.col("field_name").startswith(start), group)
    found = fields.withColumn("category", chain.otherwise("other"))
    if category is not None:
        found = found.where(F.col("category") == category)
    return found.where(F.lower(F.concat_ws(" ", "field_name", "field_value")).contains(text.lower())) if text else found


def persons_of(entities: DataFrame, persons: DataFrame) -> DataFrame:
    """Contract entities with the reconciled person of the same name: id, person (null if unknown). entities: id, type, name; persons: person."""
    known = persons.select("person", key_form(F.col("person")).alias("_key")).groupBy("_key").agg(F.min("person").alias("person"))
    return entities.where("type = 'PERSON'").select("id", key_form(F.col("name")).alias("_key")).join(known, "_key", "left").select("id", "person")


def dashboard(fields: DataFrame, least: float = 0.85) -> DataFrame:
    """Mean confidence and the number of fields below the review threshold, over all documents."""
    return fields.agg(F.count(F.lit(1)).alias("n_fields"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") < least).alias("n_low"))
