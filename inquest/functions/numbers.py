"""Scalar helpers on numbers and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, default: float) -> Column:
    """`value` as a number in [0, 1]; the default where it is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def ordered_pair(left: str, right: str) -> tuple[Column, Column]:
    """The undirected pair of two ids, the smaller first."""
    return F.least(left, right).alias("src"), F.greatest(left, right).alias("dst")


def severity(score: Column) -> Column:
    """HIGH from 0.80, MEDIUM from 0.55, else LOW."""
    return F.when(score >= 0.80, "HIGH").when(score >= 0.55, "MEDIUM").otherwise("LOW")


def numbered(prefix: str, number: Column, digits: int) -> Column:
    """An id such as COMM_001; numbers with more digits keep them all."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0")))


def money(text: Column) -> Column:
    """A number from text with currency signs and thousands commas, null if there is none."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
