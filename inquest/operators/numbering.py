"""Numbers in a global order without a single task: rows are dealt by ranges, numbered in their range, and ranges are summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquest.storage import stored

#: Bits of the row number in what Spark gives as increasing id; the bits above number the partition.
_BITS = 33


def _in_ranges(df: DataFrame, order: tuple) -> DataFrame:
    """`df` sorted by ranges, with `_part` and `_row` (from 0): the range of a row and its place there."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranges = stored(dealt, "ranges")
    return ranges.withColumn("_part", F.shiftright("_at", _BITS)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_at")


def _before(ranges: DataFrame, amount: Column) -> DataFrame:
    """For each range the sum over all ranges before it. One row for each partition of a shuffle comes to the driver."""
    sums = sorted((r._part, r.s or 0) for r in ranges.groupBy("_part").agg(F.sum(amount).cast("long").alias("s")).collect())
    total, rows = 0, []
    for part, s in sums:
        rows.append((part, total))
        total += s
    return F.broadcast(ranges.sparkSession.createDataFrame(rows, "_part long, _before long"))


def positions(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """`df` with the place of each row (from 1) in this order. Rows equal in the order come in any order."""
    ranges = _in_ranges(df, order)
    return ranges.join(_before(ranges, F.lit(1)), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def running_sums(df: DataFrame, amount: str, *order, name: str = "running") -> DataFrame:
    """`df` with the sum of `amount`, a whole number, over all rows up to each in this order, itself included."""
    ranges = _in_ranges(df, order)
    here = F.sum(amount).over(Window.partitionBy("_part").orderBy("_row"))
    return ranges.withColumn("_here", here).join(_before(ranges, F.col(amount)), "_part").withColumn(name, F.col("_before") + F.col("_here")).drop("_part", "_row", "_before", "_here")


def ranks(df: DataFrame, by: list[str], *order, name: str = "rank") -> DataFrame:
    """`df` with the place of each row (from 1) among those with equal `by`, however many: no group comes to one task."""
    placed = stored(positions(df, *by, *order, name="_position"), "positions")
    first = placed.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("_position").alias("_first"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(first, same).withColumn(name, F.col("_position") - F.col("_first") + 1).drop("_position", "_first", *(f"_{c}" for c in by))
