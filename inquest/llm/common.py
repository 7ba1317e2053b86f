"""Helpers shared by the operators: samples, Arrow batches, and storage from the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inquest.storage import shared_dir, shared_path, stored, table

__all__ = ["batch", "in_arrow", "if_small", "shared_dir", "shared_path", "slices", "some_rows", "stored", "table", "text_of"]


def text_of(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def some_rows(df: DataFrame, most: int, *by: str) -> DataFrame:
    """At most `most` rows of `df`, the same in every run: those whose columns `by` have the smallest hashes.

    A share of the rows that holds about four times as many is picked first, so that a few rows, not some of every
    task, reach the driver whatever the size of the table.
    """
    n = df.count()
    order = F.xxhash64(*by)
    if n > 4 * most:
        df = df.where(F.pmod(order, F.lit(n)) < 4 * most)
    return df.orderBy(order, *by).limit(most)


#: Rows of a few numbers that are broadcast at most.
MOST_BROADCAST = 500_000


def if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A stored `df` of a few narrow columns, marked for broadcast if it has at most `most` rows; a join with more rows shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def in_arrow(df: DataFrame, run: Callable, schema: StructType | str, rows: int = 1000) -> DataFrame:
    """`df.mapInArrow(run, schema)` over batches of at most `rows` rows, so that work arrays stay small; Spark bounds the bytes of a batch."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)

    return df.mapInArrow(lambda batches: run(small(batches)), schema)


def slices(texts: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` characters each, so that work arrays stay small whatever the batch holds."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A record batch of `schema` from lists, numpy or Arrow arrays by name."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in schema for c in [columns[f.name]]]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
