"""Ranked lexical search: the best documents for each of many items, found by a join seeded with thresholds.

Each document becomes one row of an index: its length and how often it holds each term of the items. Per term the best
`k` impacts (score shares) are stored. An item has at least `k` documents that score as high as the kth impact of any one
of its terms: a first bound. The documents of the stored impacts are seeds; their exact scores give a higher bound.
An item's terms, highest impact first, are needed up to where the highest impacts of all that follow sum up to less than
the bound: no document without a needed term can be among the best. The needed terms generate candidates, whose partial
score with that sum must reach the bound; candidates are rescored exactly with all terms, in whole numbers.

Items are taken in blocks of a bounded number of terms, each against all documents, so that a task can hold them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inquest.llm.common import batch, if_small, in_arrow, stored, text_of

#: Documents listed for an item.
BEST = 20
#: Terms of the items of a block, with repeats between items. One item alone may have more.
MOST_TERMS = 200_000
#: Cells of a work matrix of documents times items.
CELLS = 2_000_000
#: A longer text is cut into terms one after the other, without a list of all.
LONG = 4_000_000
#: Fixed values of the score: its scale and how it weighs lengths (in hundredths).
SCALE, SHARE, K1 = 1_000_000_000, 25, 12
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str) -> Counter:
    """Terms and their occurrences."""
    text = text.translate(_LOWER)
    return Counter(_TERM.findall(text) if len(text) < LONG else (m[0] for m in _TERM.finditer(text)))


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["item_id", "terms", "times"])

    rows = items.select(F.col(key).alias("item_id"), text_of(text).alias("text"))
    return in_arrow(rows, run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, terms array<string>, times array<long>", 200)


class Block:
    """Items in a form that tasks can hold: for each term the items that hold it, and per item what the bounds say."""

    def __init__(self, items: list) -> None:
        self.ids = [i.item_id for i in items]
        self.terms = sorted({t for i in items for t in i.terms})
        number = {t: k for k, t in enumerate(self.terms)}
        self.item = np.array([k for k, i in enumerate(items) for _ in i.terms], np.int64)
        self.term = np.array([number[t] for i in items for t in i.terms], np.int64)
        self.times = np.array([n for i in items for n in i.times], np.int64)
        self.weight = np.zeros(len(self.terms), np.int64)
        self.bound = np.zeros(len(items), np.int64)
        self.rest = np.zeros(len(items), np.int64)
        self.needed = np.ones(len(self.item), bool)

    def raise_bound(self, first: np.ndarray, kth: np.ndarray) -> None:
        """An item's kth score is at least the kth impact of each of its terms."""
        np.maximum.at(self.bound, self.item, self.times * kth[self.term])
        self.highest = self.times * first[self.term]

    def prune(self) -> None:
        """Drops terms from the least impact on, as long as all that are dropped sum up to less than the item's bound."""
        order = np.lexsort((self.highest, self.item))
        item, share = self.item[order], self.highest[order]
        sums = np.cumsum(share)
        begin = np.searchsorted(item, np.arange(len(self.ids)))
        sums -= np.concatenate([[0], sums])[begin][item]
        dropped = sums < self.bound[item]
        self.needed[order] = ~dropped
        self.rest[:] = 0
        np.add.at(self.rest, item[dropped], share[dropped])

    def by_term(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of each term, and the items and times of the chosen entries, in the order of terms."""
        at = np.flatnonzero(chosen)
        at = at[np.argsort(self.term[at], kind="stable")]
        return np.searchsorted(self.term[at], np.arange(len(self.terms) + 1)), self.item[at], self.times[at]


def index(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents -> doc_id, n (terms with repeats), terms (numbers in `terms`) and times (occurrences), a row per document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(shared.value)}
        for b in batches:
            n, held, times = [], [], []
            for t in b.column("text").to_pylist():
                found = terms_of(t)
                n.append(found.total())
                some = [(number[w], c) for w, c in found.items() if w in number]
                held.append([w for w, _ in some])
                times.append([c for _, c in some])
            yield batch(schema, {"doc_id": b.column("doc_id"), "n": n, "terms": held, "times": times})

    return in_arrow(rows, run, "doc_id long, n long, terms array<int>, times array<long>", 500)


def _entries(b: pa.RecordBatch, weight: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and impact of each entry of a batch of the index."""
    terms, times = b.column("terms"), b.column("times")
    row = np.repeat(np.arange(b.num_rows), np.asarray(terms.value_lengths().fill_null(0)))
    term, tf = terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy()
    m = 100 - SHARE + np.array([SHARE * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
    return row, term, weight[term] * ((SCALE * tf) // (1000 * tf + K1 * m[row]))


def _first_of(group: np.ndarray, value: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first `k` of each group, the highest values and then the smallest ids first."""
    order = np.lexsort((doc, -value, group))
    g = group[order]
    begin = np.searchsorted(g, g)
    return order[np.arange(len(g)) - begin < k]


def _ids(b: pa.RecordBatch) -> np.ndarray:
    """Ids as numbers for ordering; null comes last."""
    return b.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()


def _best(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The first `k` rows of each group; Spark takes the first of each task before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(value), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _impacts(indexed: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Stored impacts: (term, impact, doc_id, rank), the best `k` of each term."""
    shared = indexed.sparkSession.sparkContext.broadcast(block.weight)
    schema = pa.schema([("term", pa.int32()), ("impact", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, impact = _entries(b, shared.value, n_docs, n_terms)
            top = _first_of(term, impact, _ids(b)[row], k)
            top = top[impact[top] > 0]
            yield batch(schema, {"term": term[top].astype(np.int32), "impact": impact[top], "doc_id": b.column("doc_id").take(pa.array(row[top]))})

    return _best(in_arrow(indexed, run, "term int, impact long, doc_id long", 4000), "term", "impact", k)


def _scores(indexed: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score, rank): exact scores of the candidates that reach the bound, the best `k` of each item."""
    items = len(block.ids)
    shared = indexed.sparkSession.sparkContext.broadcast((block.weight, block.by_term(block.needed), block.by_term(~block.needed), block.bound, block.rest))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def met(row, term, impact, lists):
        """Cells (row times items) and shares of entries with the items of their terms."""
        offsets, item, times = lists
        some = offsets[term + 1] - offsets[term]
        at = np.repeat(offsets[term] - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(some.sum())
        return np.repeat(row, some) * items + item[at], np.repeat(impact, some) * times[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, needed, others, bound, rest = shared.value
        for b in batches:
            row, term, impact = _entries(b, weight, n_docs, n_terms)
            score = np.zeros(b.num_rows * items, np.int64)
            np.add.at(score, *met(row, term, impact, needed))
            cell = np.flatnonzero(score)
            cell = cell[score[cell] + rest[cell % items] >= bound[cell % items]]
            candidate = np.zeros(len(score), bool)
            candidate[cell] = True
            more, share = met(row, term, impact, others)
            np.add.at(score, more[candidate[more]], share[candidate[more]])
            cell = cell[score[cell] >= bound[cell % items]]
            cell = cell[_first_of(cell % items, score[cell], _ids(b)[cell // items], k)]
            yield batch(schema, {"item": (cell % items).astype(np.int32), "doc_id": b.column("doc_id").take(pa.array(cell // items)), "score": score[cell]})

    return _best(in_arrow(indexed, run, "item int, doc_id long, score long", max(1, min(4000, CELLS // items))), "item", "score", k)


def _search(docs: DataFrame, items: list, kind: str, k: int, key: str, text: str) -> DataFrame:
    """The best documents for the items of a block."""
    spark = docs.sparkSession
    block = Block(items)
    indexed = stored(index(docs, block.terms, key, text), "index")
    n_docs, n_terms = (int(x or 0) for x in indexed.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
    if n_docs:
        held = indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = np.zeros(len(block.terms), np.int64)
        df[held.column("term").to_numpy()] = held.column("df").to_numpy()
        block.weight[:] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
        impacts = stored(_impacts(indexed, block, n_docs, n_terms, k), "impacts")
        per_term = impacts.groupBy("term").agg(F.max("impact").alias("first"), F.max(F.when(F.col("rank") == k, F.col("impact"))).alias("kth")).toArrow()
        first, kth = np.zeros((2, len(block.terms)), np.int64)
        for values, name in ((first, "first"), (kth, "kth")):
            values[per_term.column("term").to_numpy()] = per_term.column(name).fill_null(0).to_numpy()
        block.raise_bound(first, kth)
        seeds = stored(impacts.select("doc_id").distinct(), "seeds", (impacts,))
        reached = _scores(indexed.join(if_small(seeds), "doc_id", "left_semi"), block, n_docs, n_terms, k).where(F.col("rank") == k).select("item", "score").toArrow()
        np.maximum.at(block.bound, reached.column("item").to_numpy().astype(np.int64), reached.column("score").to_numpy())
        block.prune()
    best = stored(_scores(indexed, block, n_docs, max(1, n_terms), k), "best", (indexed,))
    ids = spark.createDataFrame([(n, i) for n, i in enumerate(block.ids)], f"item int, item_id {kind}")
    return best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's `k` best documents with a score above 0: item_id, rank (1 is the best), doc_id, score.

    Equal scores are ordered by doc_id, ascending, a null id last. Null and empty texts have no terms: such documents
    are never listed, such items list none. Long texts are read whole. Repeated documents are listed each by itself,
    repeated items list the same documents again. Without documents or items the result is empty. Other columns of the
    two tables are not read, so their names cannot clash. An item of some 300,000 terms is the most that whole numbers of
    64 bits can sum up. Ids of documents are whole numbers.
    """
    asked = stored(_item_terms(items, item_key, item_text), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    kind, blocks = asked.schema["item_id"].dataType.simpleString(), -(-total // MOST_TERMS)
    found = []
    for i in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == i).where(F.size("terms") > 0).orderBy("item_id").collect()
        if mine:
            found.append(_search(docs, mine, kind, k, key, text))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), lengths AS (SELECT line, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
sums AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), held AS (
  SELECT line, term, count(*)::BIGINT AS tf FROM (SELECT line, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), sums
), scored AS (
  SELECT item_id, line, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN lengths USING (line) JOIN asked USING (term), sums GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
