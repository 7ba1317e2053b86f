"""Pairs of sets that overlap enough, without comparing all pairs and without losing one.

The overlap that a pair needs follows from its two sizes. Elements are put in one order, the rarest first. Two sets of
sizes n and m with at least `o` common elements share `k` of the first n - o + k and m - o + k: a key is the two sizes
and `k` such elements. With k above 1 keys are many and rare, which small alphabets need. A pair meets under several
keys and is kept under one: that of its first common elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.storage import stored

#: Elements above which a set is keyed by single elements, whatever its partner's size: keys would be too many.
LONG = 64


def _needed(measure: str, least: float, n: Column, m: Column) -> Column:
    """Common elements that sets of sizes n and m need."""
    share = least / 2 if measure == "dice" else least / (1 + least)
    return F.ceil((n + m) * share - 1e-9).cast("int")


def _largest(measure: str, least: float) -> float:
    """How many times as large the larger set of a pair may be."""
    return (2 - least) / least if measure == "dice" else 1 / least


def _rarest_first(sets: DataFrame) -> DataFrame:
    """Sets (id, block, items) with their elements in one order, the rarest first, as numbers."""
    each = stored(sets.select("id", "block", F.explode(F.array_distinct("items")).alias("item")), "elements")
    often = each.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    joined = each.join(often, "item").groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("often", F.xxhash64("item").alias("item")))).alias("items"))
    return stored(joined.select("id", "block", F.transform("items", lambda x: x["item"]).alias("items"), F.size("items").alias("n")), "ordered-sets")


def set_pairs(sets: DataFrame, least: float, measure: str = "jaccard", shared: int = 1) -> DataFrame:
    """Sets (id, block, items) -> (left_id, right_id, common, n_left, n_right): all pairs of a block with at least this likeness.

    `measure` is jaccard (common over all) or dice (twice the common ones over both sizes). The smaller set is on the
    left, of equal sizes the one with the smaller id. Empty sets are in no pair. Ids name a set once.
    """
    if not 0 < least <= 1 or measure not in ("jaccard", "dice") or shared not in (1, 2):
        raise ValueError("least must be in (0, 1], the measure jaccard or dice, and shared 1 or 2")
    ordered, times = _rarest_first(sets), _largest(measure, least)
    n, most, fewest = F.col("n"), F.floor(F.col("n") * times + 1e-9).cast("int"), F.ceil(F.col("n") / times - 1e-9).cast("int")
    sizes = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    as_left, as_right = sizes(n, F.least(most, F.lit(LONG))), F.when(n <= LONG, sizes(fewest, n)).otherwise(F.array().cast("array<int>"))
    role = lambda name, partners: F.transform(partners, lambda m: F.struct(F.lit(name).alias("role"), m.alias("m")))
    # Pairs with a long set: the fewest common elements that any such partner leaves.
    first = F.when(n > LONG, fewest).otherwise(LONG + 1)
    long = F.when(most > LONG, F.array(F.struct(F.lit("long").alias("role"), first.cast("int").alias("m")))).otherwise(F.array())
    rows = ordered.select("id", "block", "items", "n", F.inline(F.concat(role("left", as_left), role("right", as_right), long)))
    o = _needed(measure, least, F.col("n"), F.col("m"))
    k = F.when(F.col("role") == "long", 1).otherwise(F.least(F.lit(shared), o))
    rows = rows.withColumn("k", k).withColumn("front", F.slice("items", F.lit(1), F.greatest(F.lit(0), F.least(n, n - o + F.col("k")))))
    single = F.transform("front", lambda x: F.xxhash64(x, F.lit(0).cast("long")))
    double = F.flatten(F.transform("front", lambda x, i: F.transform(F.slice("front", i + 2, F.size("front")), lambda y: F.xxhash64(x, y))))
    of_sizes = F.when(F.col("role") == "long", F.lit(0)).otherwise(F.least("n", "m") * 100_000 + F.greatest("n", "m"))
    keyed = rows.select("id", "block", "items", "n", "role", "k", of_sizes.alias("sizes"), F.explode(F.when(F.col("k") == 1, single).otherwise(double)).alias("key"))
    side = lambda roles, name: keyed.where(F.col("role").isin(*roles)).select("block", "sizes", "key", "k", *(F.col(c).alias(f"{name}_{c}") for c in ("id", "items", "n")))
    met = side(("left", "long"), "left").join(side(("right", "long"), "right"), ["block", "sizes", "key", "k"])
    in_order = (F.col("left_n") < F.col("right_n")) | ((F.col("left_n") == F.col("right_n")) & (F.col("left_id") < F.col("right_id")))
    met = met.where(in_order & ((F.col("sizes") > 0) | (F.col("right_n") > LONG))).withColumn("both", F.array_intersect("left_items", "right_items"))
    element = lambda i: F.try_element_at("both", F.lit(i))
    own = F.when(F.col("k") == 1, F.xxhash64(element(1), F.lit(0).cast("long"))).otherwise(F.xxhash64(element(1), element(2)))
    kept = met.where((own == F.col("key")) & (F.size("both") >= _needed(measure, least, F.col("left_n"), F.col("right_n"))))
    return kept.select("left_id", "right_id", F.size("both").alias("common"), F.col("left_n").alias("n_left"), F.col("right_n").alias("n_right"))


def letters(names: DataFrame) -> DataFrame:
    """Names (id, block, name) as sets of their characters, repeats numbered: two sets have as many common elements as the names have characters in any order."""
    each = names.where("name <> ''").select("id", "block", F.explode(F.split("name", "")).alias("c")).where("c <> ''").groupBy("id", "block", "c").agg(F.count(F.lit(1)).cast("int").alias("n"))
    numbered = each.select("id", "block", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.col("c"), i.cast("string")))).alias("item"))
    return numbered.groupBy("id", "block").agg(F.collect_list("item").alias("items"))
