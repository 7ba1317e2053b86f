"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated Poisson(r_s) times, where r_s is the mean
number of repetitions that brings its source to the target share of the mix.
The Poisson draw inverts the distribution function at a uniform number taken
from a hash of the seed and the document, so that it needs no state, is the
same in every run and on every retry, and changes only with the seed.
Built-in functions only; one shuffle, by the hash that also sets the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import stored

#: A mean above this is drawn as a sum of so many Poisson draws of at most this mean.
MOST_MEAN = 16
#: Terms of the distribution function that are kept; beyond them lies under 2**-60 of a mean of MOST_MEAN.
TERMS = 80
#: Sources up to which the table of rates is sent to all executors (about 1 KB each).
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined with '|'."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict | None = None, source: str = "source", size: int | None = None) -> DataFrame:
    """Per source: its number of documents and the mean number of repetitions of each.

    weights: target shares by source, in any unit (missing ones are 0; null is the key None). None: equal shares for
    all sources. size: documents in the mix, the corpus's own number when None. A source of weight 0 gets rate 0.
    """
    counts = docs.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        spark = docs.sparkSession
        kind = docs.schema[source].dataType.simpleString()
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], f"key {kind}, weight double")
        weighed = counts.join(given, counts[source].eqNullSafe(given["key"]), "left").select(counts[source], "n_docs", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = stored(weighed, "weights")
    total, all_docs = weighed.agg(F.sum("weight"), F.sum("n_docs")).first()
    rate = F.col("weight") / F.lit(total) * F.lit(float(all_docs if size is None else size)) / F.col("n_docs") if total else F.lit(0.0)
    return weighed.select(source, "n_docs", rate.alias("rate"))


def draws(rate: Column) -> Column:
    """The number of Poisson draws that make up one of this mean."""
    return F.greatest(F.lit(1), F.ceil(rate / MOST_MEAN)).cast("int")


def distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1."""
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def grow(made: Column, k: Column) -> Column:
        p = made["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(made["sums"], F.array(F.element_at(made["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), first, grow, lambda made: made["sums"])


def replicate(docs: DataFrame, weights: dict | None = None, seed: int = 42, source: str = "source", doc_id: str = "doc_id", size: int | None = None) -> DataFrame:
    """The mix: every row of `docs` as often as its draw says, in an order that is random over the whole mix.

    Returns the columns of `docs` with `copy` (0 .. count - 1) and `shuffle_key`; existing columns of these names are
    replaced. Rows are dealt by the hash in `shuffle_key` and sorted by it inside each partition. Rows with the same
    doc_id (null is an id too) draw the same count, each for itself; a null source is a source of its own. Texts may
    be null, empty or of any length. An empty table gives an empty mix.
    """
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rate = rates(docs, weights, source, size)
    table = rate.select(
        F.col(source).alias("_source"),
        F.when(F.col("rate") > 0, draws(F.col("rate"))).otherwise(0).alias("_draws"),
        distribution(F.col("rate") / draws(F.col("rate"))).alias("_below"),
    )
    if rate.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    below = F.col("_below")
    one = lambda j: F.size(F.filter(below, lambda p: p <= uniform(F.lit(seed), ident, j)))
    count = F.aggregate(F.sequence(F.lit(0), F.col("_draws") - 1), F.lit(0), lambda n, j: n + one(j))
    drawn = docs.join(table, docs[source].eqNullSafe(table["_source"])).where("_draws > 0").withColumn("_count", count).where("_count > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    keyed = copies.select(*kept, F.col("copy").cast("long"), F.md5(F.concat_ws("|", F.lit(f"order {seed}"), ident, F.col("copy").cast("string"))).alias("shuffle_key"))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM counts) * (SELECT count(*) FROM documents) / n AS rate FROM counts
), parts AS (
  SELECT source, CAST(greatest(1, ceil(rate / {MOST_MEAN})) AS INTEGER) AS draws, rate / greatest(1, ceil(rate / {MOST_MEAN})) AS mean FROM rates
), terms AS (
  SELECT source, draws, k,
         sum(exp(-mean + k * ln(mean) - coalesce((SELECT sum(ln(i)) FROM range(1, k + 1) t(i)), 0))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM parts, range({TERMS}) r(k)
), drawn AS (
  SELECT d.doc_id, d.source, count(*) AS n
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source,
       range(p.draws) j(j), terms t
  WHERE t.source IS NOT DISTINCT FROM d.source
    AND t.below <= CAST('0x' || substr(md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || j.j), 1, 13) AS BIGINT) / 4503599627370496.0
  GROUP BY d.doc_id, d.source
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.c AS copy,
       md5('order 42|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || c.c) AS shuffle_key
FROM documents d JOIN drawn n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source, range(n.n) c(c)
"""
