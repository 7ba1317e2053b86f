"""Nested values taken apart: all plain values below a JSON value, to any depth, and one form for equal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.storage import stored

#: Levels of nested values that are taken apart in one pass.
LEVELS = 4


def nested(text: Column) -> Column:
    """A text as VARIANT if it is a JSON array or object, else null: plain texts that look like numbers stay texts."""
    return F.try_parse_json(F.when(F.ltrim(text).rlike(r"^[\[{]"), text))


def canonical(text: Column) -> Column:
    """Equal nested values as equal texts: JSON without blanks, keys in order. Plain texts as they are."""
    return F.coalesce(F.to_json(nested(text)), text)


def _deeper(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(?:ARRAY|OBJECT)")


def _items(v: Column) -> Column:
    """The values in an array or object."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))


def _unfolded(v: Column, value: str) -> Column:
    """Distinct values LEVELS levels below an array or object: plain ones as text in `value`, arrays and objects that are left as `_json`."""
    items = _items(v)
    for _ in range(LEVELS - 1):
        items = F.flatten(F.transform(items, lambda x: F.when(_deeper(x), _items(x)).otherwise(F.array(x))))
    plain = lambda x: F.try_variant_get(x, "$", "string")
    shown = lambda x: F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(plain(x))).otherwise(plain(x))
    return F.array_distinct(F.transform(items, lambda x: F.struct(F.when(~_deeper(x), F.trim(shown(x))).alias(value), F.when(_deeper(x), F.to_json(x)).alias("_json"))))


def leaves(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Rows (keys, value) -> (keys, value): a row for each distinct plain value in `value`, blanks around it cut off.

    Values are texts; those that are JSON arrays or objects are taken apart LEVELS levels at a time until none is left,
    inside the row, so that what lies between is neither written nor shuffled. Only values that are deeper are written
    to the shared folder and taken apart further. Nulls and empty texts give no row; true and false are written True and
    False; broken JSON is a plain text.
    """
    top = rows.select(*keys, F.col(value).alias("_text"), nested(F.col(value)).alias("_v"))
    found = [top.where("_v is null").select(*keys, F.trim("_text").alias(value))]
    inner, done = top.where("_v is not null").select(*keys, "_v"), None
    while True:
        level = stored(inner.select(*keys, F.inline(_unfolded(F.col("_v"), value))), "nested", (done,))
        found.append(level.where("_json is null").select(*keys, value))
        if level.where("_json is not null").isEmpty():
            break
        done = stored(level.where("_json is not null").select(*keys, "_json").distinct(), "nested")
        inner = done.select(*keys, F.parse_json("_json").alias("_v"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where(F.col(value) != "").distinct()
