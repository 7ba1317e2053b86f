"""Exact n-gram Jaccard join by prefix trees.

Two documents link when their shingle sets have a Jaccard similarity of at
least 0.8. Equal sets are one class. A set of n elements that links with any
other has at most n / 5 elements that no other set holds. So a sample of
elements, the same for all sets (those with the smallest hashes), is counted
first: sets with more unshared ones than that link with nothing and go. What
stays is ordered as a whole, the rarest elements among these sets first;
linked sets share one of their first n / 5 + 1 elements (a prefix filter).
Classes that such keys join form candidate clusters. Inside a cluster the sets,
in one global element order, are stored in a trie; each set walks it, shares
the overlap of common prefixes, and leaves subtrees whose remaining lengths
cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inquest.llm.common import batch, if_small, in_arrow, stored, text_of
from inquest.operators.components import components
from inquest.llm.shingles import shingles, words_of

#: From this share of documents on, and at most so many, elements count as frequent.
FREQUENT, MOST_FREQUENT = 0.001, 1_000_000
#: Sets of up to so many elements are sampled whole, of larger ones this share of all hashes.
SAMPLED_WHOLE, SAMPLE = 100, 0.4
#: Sets of a task in a cluster; sets that all members of a larger cluster meet first.
BLOCK, PIVOTS = 128, 4


def links(n_both: int, n_left: int, n_right: int) -> bool:
    """100 * both >= 80 * union."""
    return 9 * n_both >= 4 * (n_left + n_right)


def limit(n: int) -> np.uint64:
    """The hash below which elements of a set of n are sampled: not larger for a larger set."""
    return np.uint64(2**64 - 1 if n <= SAMPLED_WHOLE else int(SAMPLE * 2**64))


def is_frequent(elements: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which elements are in the sorted `frequent`."""
    if not len(frequent):
        return np.zeros(len(elements), bool)
    return frequent[np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)] == elements


def sampled(elements: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a set (sorted distinct hashes) the sampled elements that are not frequent, whether each counts for the set, and how many of those must be shared.

    A set that links with this one has at most 5 / 4 of its elements, so elements below the limit of that size are
    sampled there as well: those count. At most a fifth of the set is not in the other; frequent elements are shared.
    """
    n = len(elements)
    own = int(np.searchsorted(elements, limit(5 * n // 4), "right"))
    picked = elements[: np.searchsorted(elements, limit(n), "right")]
    often = is_frequent(picked, frequent)
    return picked[~often], (np.arange(len(picked)) < own)[~often], own - n // 5 - int(often[:own].sum())


def _sets(texts: list[str]) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each text its shingle set and the two halves of the set's digest."""
    for words in words_of(texts):
        s = np.unique(shingles(words))
        d = xxhash.xxh3_128_digest(s.tobytes())
        yield s, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _profiles(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n, d1, d2; and rows without n that hold an element (d1) and its count (d2) where a task saw it often."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        often: dict[int, int] = {}
        held: list[np.ndarray] = []

        def count() -> None:
            """Adds the elements that several documents of the part hold; an element must reach the share in some part."""
            if held:
                value, n = np.unique(np.concatenate(held), return_counts=True)
                many = n >= max(3, FREQUENT * len(held))
                for v, k in zip(value[many].view(np.int64).tolist(), n[many].tolist()):
                    often[v] = often.get(v, 0) + k
                held.clear()

        for b in batches:
            rows, size = [], 0
            for doc_id, (s, d1, d2) in zip(b.column("doc_id").to_pylist(), _sets(b.column("text").to_pylist())):
                rows.append((doc_id, len(s), d1, d2))
                if (d1, d2) not in seen:
                    seen.add((d1, d2))
                    held.append(s)
            yield batch(arrow, {k: [r[i] for r in rows] for i, k in enumerate(arrow.names)})
            if sum(map(len, held)) > 2_000_000:
                count()
        count()
        if often:
            yield batch(arrow, {"doc_id": pa.nulls(len(often), pa.int64()), "n": pa.nulls(len(often), pa.int64()), "d1": list(often), "d2": list(often.values())})

    return stored(in_arrow(docs, run, "doc_id long, n long, d1 long, d2 long"), "profiles")


def _frequent(profiles: DataFrame) -> np.ndarray:
    """Elements of many documents, sorted: at most MOST_FREQUENT numbers."""
    n_docs, total = profiles.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(8, FREQUENT * n_docs, total / MOST_FREQUENT)
    found = profiles.where("n IS NULL").groupBy("d1").agg(F.sum("d2").alias("k")).where(F.col("k") >= least).select("d1").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


class Trie:
    """A compressed prefix tree over sets given as increasing arrays of element ranks."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets, self.order = sets, order
        self.common = [0] * len(order)  # with the set before in order
        for k in range(1, len(order)):
            a, b = sets[order[k - 1]], sets[order[k]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[k] = int(differ[0]) if len(differ) else m
        # (elements of the edge, depth behind it, least and largest set size below, sets that end here, children)
        self.root = self._node(0, len(order), 0) if order else None

    def _node(self, lo: int, hi: int, depth: int) -> tuple:
        first = self.sets[self.order[lo]]
        end = min((self.common[k] for k in range(lo + 1, hi)), default=len(first))
        sizes = [len(self.sets[self.order[k]]) for k in range(lo, hi)]
        ends = [self.order[k] for k in range(lo, hi) if len(self.sets[self.order[k]]) == end]
        children, at = [], lo + len(ends)
        while at < hi:
            stop = at + 1
            while stop < hi and self.common[stop] > end:
                stop += 1
            children.append((at, stop))
            at = stop
        return first[depth:end], end, min(sizes), max(sizes), ends, [self._node(a, b, end) for a, b in children]

    def near(self, ranks: np.ndarray, member: np.ndarray) -> Iterator[int]:
        """Positions of the sets that link with the set of these ranks; member: whether each rank is in it."""
        n, todo = len(ranks), [(self.root, 0)] if self.root else []
        while todo:
            (edge, depth, least, most, ends, children), both = todo.pop()
            passed = 0
            if depth:
                if len(edge):
                    both += int(member[edge].sum())
                    passed = int(np.searchsorted(ranks, edge[-1], "right"))
                reach = both + min(most - depth, n - passed)
                if 9 * reach < 4 * (n + least):
                    continue
            for k in ends:
                if links(both, n, depth):
                    yield k
            todo.extend((c, both) for c in children)


def _ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets in a global order, frequent elements first so that near-copies share long prefixes, and the number of ranks."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    value, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.int64)
    rank[np.lexsort((value, -n))] = np.arange(len(value))
    cuts = np.cumsum([0, *map(len, sets)])
    return [np.sort(rank[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])], len(value)


def join_block(reps: list[int], sets: list[np.ndarray], probes: list[bool], stored_: list[bool]) -> list[tuple[int, int]]:
    """Links of a task as a forest over reps: every probe walks the trie of the stored sets; sets that links join already are passed over."""
    ranked, n = _ranked(sets)
    held = [i for i, s in enumerate(stored_) if s]
    trie = Trie([ranked[i] for i in held])
    parent = list(range(len(reps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, member = [], np.zeros(n, bool)
    for i, probe in enumerate(probes):
        if probe:
            member[ranked[i]] = True
            for k in trie.near(ranked[i], member):
                a, b = find(i), find(held[k])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((reps[i], reps[held[k]]))
            member[ranked[i]] = False
    return out


def _decoded(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return batch(PAIRS, {"a": [x for x, _ in found], "b": [x for _, x in found]})


def _walk(rows: pa.Table) -> pa.Table:
    """Links of one task: the rows with `probe` walk the trie of the others."""
    probe = rows.column("probe").to_pylist()
    return pa.Table.from_batches([_pairs(join_block(rows.column("rep").to_pylist(), _decoded(rows.column("elements")), probe, [not p for p in probe]))])


def _large_cluster_links(members: DataFrame) -> DataFrame:
    """Links in clusters of over BLOCK sets. members: cluster, sets (their number), rep, elements.

    PIVOTS members of the cluster first walk the tries of all members, in blocks; the members that this leaves outside the
    cluster's largest component then meet all members, in blocks. The work is linear where copies resemble a pivot, and
    no link is lost.
    """
    n_blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    chosen = members.groupBy("cluster", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("slot")).agg(F.min("rep").alias("rep"))
    pivot = members.join(stored(chosen.select(F.col("rep").alias("other")), "pivots"), F.col("rep") == F.col("other"))
    held = members.select("cluster", block(n_blocks).alias("i"), F.lit(False).alias("probe"), "rep", "elements")
    sent = pivot.select("cluster", F.explode(span(n_blocks)).alias("i"), F.lit(True).alias("probe"), "rep", "elements")
    first = stored(held.unionByName(sent).groupBy("cluster", "i").applyInArrow(_walk, "a long, b long"), "pivot-links")
    parts = stored(components(first), "pivot-parts")
    placed = members.select("cluster", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("cluster", "rep", F.coalesce("component", "rep").alias("part"))
    sizes = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("n", F.negative("part"))).alias("main"))
    left = stored(placed.join(stored(largest, "largest-parts").withColumnRenamed("cluster", "of"), F.col("cluster") == F.col("of")).where("part <> main").select("cluster", "rep"), "left-over")
    if left.isEmpty():
        return first
    counts = stored(left.groupBy(F.col("cluster").alias("of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_left")), "left-blocks")
    held = members.join(counts, F.col("cluster") == F.col("of")).select("cluster", F.explode(span(F.col("n_left"))).alias("i"), block(n_blocks).alias("j"), F.lit(False).alias("probe"), "rep", "elements")
    one = members.join(left.select(F.col("rep").alias("other")), F.col("rep") == F.col("other")).join(counts, F.col("cluster") == F.col("of"))
    sent = one.select("cluster", block(F.col("n_left")).alias("i"), F.explode(span(n_blocks)).alias("j"), F.lit(True).alias("probe"), "rep", "elements")
    return first.unionByName(held.unionByName(sent).groupBy("cluster", "i", "j").applyInArrow(_walk, "a long, b long"))


def _alive(docs: DataFrame, often: Broadcast) -> DataFrame:
    """d1 of the classes that may link: enough of their sampled elements occur in another class."""
    schema = pa.schema([("element", pa.int64()), ("d1", pa.int64()), ("counts", pa.int8()), ("need", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            element, of, counts, need = [], [], [], []
            for s, d1, _ in _sets(b.column("text").to_pylist()):
                if len(s) and d1 not in seen:
                    seen.add(d1)
                    picked, own, least = sampled(s, often.value)
                    element += [picked.view(np.int64), np.array([d1])]  # the last row holds what the set needs
                    of.append(np.full(len(picked) + 1, d1))
                    counts.append(np.append(own, False).astype(np.int8))
                    need.append(np.append(np.full(len(picked), np.iinfo(np.int32).min, np.int32), np.int32(least)))
            if of:
                least = np.concatenate(need)
                yield batch(schema, {"element": np.concatenate(element), "d1": np.concatenate(of), "counts": np.concatenate(counts), "need": pa.array(least, mask=least == np.iinfo(np.int32).min)})

    dealt = in_arrow(docs.select("text"), run, "element long, d1 long, counts tinyint, need int")
    same = Window.partitionBy("element")
    shared = dealt.withColumns({"low": F.min("d1").over(same), "high": F.max("d1").over(same)}).where("low <> high AND counts > 0 OR need IS NOT NULL")
    sums = shared.groupBy("d1").agg(F.sum(F.when(F.col("need").isNull(), F.lit(1)).otherwise(0)).alias("shared"), F.max("need").alias("need"))
    return stored(sums.where("shared >= need").select("d1"), "may-link")


def _keys(found: DataFrame) -> DataFrame:
    """Keys of sets (key, rep): the first n / 5 + 1 elements, rarest first, that another of these sets holds; frequent elements last.

    found: rep, spare (elements that are not frequent, less the n / 5 + 1), rare (those elements), firm (frequent ones in the prefix).
    """
    schema = pa.schema([("element", pa.int64()), ("rep", pa.int64()), ("spare", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rare = _decoded(b.column("rare"))
            n = np.array([len(x) for x in rare], np.int64)
            rep, spare = (np.repeat(b.column(k).to_numpy(), n) for k in ("rep", "spare"))
            yield batch(schema, {"element": np.concatenate(rare).view(np.int64) if rare else [], "rep": rep, "spare": spare})

    rows = in_arrow(found.select("rep", "spare", "rare"), run, "element long, rep long, spare int")
    shared = rows.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("element"))).where("held > 1")
    own = Window.partitionBy("rep")
    ranked = shared.withColumn("n", F.count(F.lit(1)).over(own)).where("n > spare").withColumn("nth", F.row_number().over(own.orderBy("held", "element")))
    # elements of one set only come first in its order: they are no keys, but take places of the prefix
    rare = ranked.where("nth <= n - spare").select(F.col("element").alias("key"), "rep")
    return stored(rare.unionByName(found.select(F.explode("firm").alias("key"), "rep")), "prefix-keys")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included).

    Null texts and texts without words have no shingles and link with nothing. Rows with equal doc_id are one document for
    the links. A null doc_id gets the component of its class of equal sets, if that has any id, else null. An empty table
    gives an empty result; other columns take no part, whatever their names. Texts of any length are read whole, in slices.
    Digests, sampled elements and the sets of candidates cross the network; texts only where their ids are too many to broadcast.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    profiles = _profiles(docs)
    often = docs.sparkSession.sparkContext.broadcast(_frequent(profiles))
    own = profiles.where("n IS NOT NULL")
    sized = own.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(sized.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "classes")
    alive = _alive(docs.where("doc_id IS NOT NULL"), often)
    chosen = stored(classes.join(alive.withColumnRenamed("d1", "of"), F.col("d1") == F.col("of")).select("rep", F.col("d1").alias("c1"), F.col("d2").alias("c2")), "candidates")
    kept = pa.schema([("rep", pa.int64()), ("spare", pa.int32()), ("rare", pa.binary()), ("often", pa.binary()), ("firm", pa.list_(pa.int64()))])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            rows: dict[str, list] = {k: [] for k in kept.names}
            for rep, c1, c2, (s, d1, d2) in zip(*(b.column(k).to_pylist() for k in ("rep", "c1", "c2")), _sets(b.column("text").to_pylist())):
                if (c1, c2) == (d1, d2) and (rep, d1, d2) not in seen:
                    seen.add((rep, d1, d2))
                    mask = is_frequent(s, often.value)
                    spare = int((~mask).sum()) - len(s) // 5 - 1
                    values = (rep, spare, s[~mask].tobytes(), s[mask].tobytes(), s[mask][: max(0, -spare)].view(np.int64))
                    for k, v in zip(kept.names, values):
                        rows[k].append(v)
            yield batch(kept, rows)

    asked = docs.join(if_small(chosen), F.col("doc_id") == F.col("rep")).select("rep", "c1", "c2", "text")
    found = stored(in_arrow(asked, fetch, "rep long, spare int, rare binary, often binary, firm array<long>"), "sets")
    keys = _keys(found)
    shared = stored(keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select(F.col("key").alias("of"), "low"), "shared-keys")
    met = keys.join(shared, F.col("key") == F.col("of")).select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    clusters = stored(components(met), "clusters", (keys, shared))
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("sets"))
    named = stored(clusters.join(sizes.withColumnRenamed("component", "cluster"), F.col("component") == F.col("cluster")).select("node", "cluster", "sets"), "cluster-members")
    members = found.join(named, F.col("rep") == F.col("node")).select("cluster", "sets", "rep", F.concat("rare", "often").alias("elements"))

    def walk(rows: pa.Table) -> pa.Table:
        every = [True] * rows.num_rows
        return pa.Table.from_batches([_pairs(join_block(rows.column("rep").to_pylist(), _decoded(rows.column("elements")), every, every))])

    linked = members.where(F.col("sets") <= BLOCK).select("cluster", "rep", "elements").groupBy("cluster").applyInArrow(walk, "a long, b long")
    if not named.where(F.col("sets") > BLOCK).isEmpty():
        linked = linked.unionByName(_large_cluster_links(stored(members.where(F.col("sets") > BLOCK), "large-clusters")))
    parts = components(stored(linked, "jaccard-links"))
    grouped = classes.join(stored(parts, "jaccard-parts"), F.col("rep") == F.col("node"), "left").where("copies > 1 OR component IS NOT NULL")
    groups = stored(grouped.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("component", "rep").alias("component")), "jaccard-groups")
    out = own.join(groups, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose document is the first (by doc_id) of its near-duplicate group.

    Rows without an id stay, and all columns as they are. Texts cross the network only where the decisions are too many to broadcast.
    """
    groups = near_duplicates(docs, doc_id, text)
    goes = stored(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_goes")).distinct(), "duplicates")
    return docs.join(if_small(goes), F.col(doc_id) == F.col("_goes"), "left_anti")
