"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one kept per component.

A vector has a home cell (its nearest centre) and is a member of the cells of its
NEAR nearest centres: a fixed number, whatever the table holds. Home vectors of a
cell are compared with all its members. With cosine 0.9 between two vectors, the
centre nearest to one is among the nearest of the other but for rare cases; the
recall is measured in the tests and the README. Tables of more than MOST_CELLS
times CELL vectors have cells in cells: the directions from the centre to its
vectors are clustered as well, so that cells stay small. Cells of any size are cut
into blocks, each pair of blocks a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import batch, in_arrow, some_rows, stored
from inquest.operators.components import components

#: Vectors per cell aimed at, the most centres of a level, and the vectors that centres are fitted to.
CELL, MOST_CELLS, SAMPLE = 256, 2048, 16_384
#: Cells that a vector is a member of; with two levels, centres of the first and cells of the second below each.
NEAR, NEAR_FIRST, NEAR_SECOND = 16, 8, 4
#: Home vectors and members of a task.
HOMES, MEMBERS = 1024, 8192


def spherical_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centres of unit vectors: each round moves a centre to the direction of the sum of its vectors."""
    order = np.random.default_rng(5).permutation(len(x))
    centres = x[order[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def usable(vector: str) -> Column:
    """Whether a vector can link: not null or empty, all components finite, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows: pa.Array) -> list[np.ndarray]:
    flat, at = rows.values.to_numpy(zero_copy_only=False).astype(np.float64), rows.offsets.to_numpy()
    out = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    return [v / np.abs(v).max() for v in out]


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors)
    return x / np.linalg.norm(x, axis=1)[:, None]


@dataclass(frozen=True)
class Cells:
    """Centres of one dimension and, where the table is large, directions from a centre that part its cell again."""

    first: np.ndarray
    second: np.ndarray | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        """Per unit vector the cells that it is a member of, its home first."""
        near = x @ self.first.T
        top = _largest(near, NEAR if self.second is None else NEAR_FIRST)
        if self.second is None:
            return top
        # the part of a vector that its centre leaves, against the directions
        both, beside = self.first @ self.second.T, x @ self.second.T
        left = beside[:, None, :] - np.take_along_axis(near, top, 1)[:, :, None] * both[top]
        k = min(NEAR_SECOND, len(self.second))
        low = _largest(left.reshape(-1, len(self.second)), k).reshape(len(x), top.shape[1], k)
        return (top[:, :, None] * len(self.second) + low).reshape(len(x), -1)


def _largest(x: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, the largest first."""
    k = min(k, x.shape[1])
    some = np.argpartition(-x, k - 1, 1)[:, :k]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(x, some, 1), 1, kind="stable"), 1)


def fit_cells(distinct: DataFrame, vector: str = "embedding") -> dict[int, Cells]:
    """Cells by dimension, from a sample of bounded size (the first SAMPLE vectors by a hash)."""
    n = distinct.count()
    table = some_rows(distinct.select(vector), SAMPLE, vector).toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for chunk in table.column(0).chunks:
        for v in _unit(chunk):
            found.setdefault(len(v), []).append(v)
    read = sum(map(len, found.values()))
    out = {}
    for d, v in found.items():
        x, wanted = _matrix(v), n * len(v) / read / CELL
        first = spherical_means(x, max(1, min(MOST_CELLS, len(v) // 4, round(wanted))))
        parts = min(MOST_CELLS, len(v) // 4, round(wanted / len(first)))
        if wanted <= MOST_CELLS or parts < 2:
            out[d] = Cells(first)
            continue
        near = x @ first.T
        left = x - near.max(1)[:, None] * first[near.argmax(1)]
        size = np.linalg.norm(left, axis=1)
        left = left[size > 1e-9] / size[size > 1e-9, None]
        out[d] = Cells(first, spherical_means(left, min(parts, len(left)))) if len(left) else Cells(first)
    return out


def _cells(vectors: list[np.ndarray], cells: dict[int, Cells]) -> Iterator[tuple[list[int], int, np.ndarray]]:
    """By dimension, in small groups: positions, dimension, and the cells of each vector (one cell where there are no centres)."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    for d, every in by.items():
        for k in range(0, len(every), 128):
            rows = every[k : k + 128]
            yield rows, d, cells[d].of(_matrix([vectors[i] for i in rows])) if d in cells else np.zeros((len(rows), 1), np.int64)


def _task_links(rows: pa.Table, threshold: float) -> dict:
    """Of one task's block pair: how many rows each representative is linked to, and a forest of its links."""
    role = rows.column("role").to_numpy()
    rep, copies, home = (rows.column(k).to_numpy() for k in ("rep", "copies", "home"))
    x = _matrix(_unit(rows.column("embedding").combine_chunks()))
    cells = rows.column("cells").to_pylist()
    h, m = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    linked = x[h] @ x[m].T >= threshold
    linked &= rep[h][:, None] != rep[m][None, :]
    cell = rows.column("cell")[0].as_py()
    count = np.zeros(len(rep), np.int64)
    np.add.at(count, h, linked @ copies[m])
    # A member counts the pair here only if its own home does not see it.
    far = np.flatnonzero(home[m] != cell)
    for i, j in zip(*np.nonzero(linked[:, far])):
        a, b = h[i], m[far[j]]
        if home[b] not in cells[a]:
            count[b] += copies[a]
    label = rep.copy()
    while linked.any():
        before = label.copy()
        label[h] = np.minimum(label[h], np.where(linked, label[m][None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        label[m] = np.minimum(label[m], np.where(linked, label[h][:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
        if (label == before).all():
            break
    some = np.flatnonzero((count > 0) | (label != rep))
    return {"rep": rep[some], "links": count[some], "low": label[some]}


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other rows at this cosine or above), component_id, kept.

    Equal vectors are compared once and counted as often as they occur. Vectors that are null, empty, zero or hold null or
    non-finite components, and vectors of another length, link with nothing. Rows with equal vec_id are vectors of their
    own with a common component; a null vec_id gets no component. An empty table gives an empty result. Other columns take
    no part, whatever their names.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    rows = rows.withColumn("key", F.when(usable("embedding"), F.md5(F.col("embedding").cast("string"))))
    reps = stored(rows.where("key IS NOT NULL AND vec_id IS NOT NULL").groupBy("key", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    cells = fit_cells(reps)
    sizes = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("homes", pa.int64()), ("members", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            for _, d, own in _cells(_unit(b.column("embedding")), cells) if b.num_rows else ():
                for k, values in enumerate((own[:, 0], own.ravel())):
                    for c, n in zip(*(x.tolist() for x in np.unique(values, return_counts=True))):
                        seen.setdefault((d, c), [0, 0])[k] += n
        yield batch(sizes, {"dim": [d for d, _ in seen], "cell": [c for _, c in seen], "homes": [n for n, _ in seen.values()], "members": [n for _, n in seen.values()]})

    counted = in_arrow(reps.select("embedding"), count, "dim int, cell long, homes long, members long").groupBy("dim", "cell").agg(F.sum("homes").alias("homes"), F.sum("members").alias("members"))
    large = counted.where((F.col("homes") > HOMES) | (F.col("members") > MEMBERS)).collect()  # a row for each cell of more than one task, at most 2048 * 2048
    blocks = {(r.dim, r.cell): (max(1, -(-r.homes // HOMES)), -(-r.members // MEMBERS)) for r in large}
    arrow = pa.schema(
        [("dim", pa.int32()), ("cell", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("role", pa.int8()), ("rep", pa.int64()), ("copies", pa.int64())]
        + [("home", pa.int64()), ("cells", pa.list_(pa.int64())), ("row", pa.int32())]
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep, copies, vector = b.column("rep").to_pylist(), b.column("copies").to_pylist(), b.column("embedding")
            for at, d, every in _cells(_unit(vector), cells):
                out: dict[str, list] = {k: [] for k in arrow.names}
                for i, own in zip(at, every.tolist()):
                    mixed = (rep[i] * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 32
                    for c in own:
                        n_home, n_member = blocks.get((d, c), (1, 1))
                        p, q = mixed % n_home, mixed % n_member
                        tasks = {(k, q): 2 for k in range(n_home)}
                        if c == own[0]:
                            for k in range(n_member):
                                tasks[p, k] = tasks.get((p, k), 0) | 1
                        for (k, l), role in tasks.items():
                            for name, value in zip(arrow.names, (d, c, k, l, role, rep[i], copies[i], own[0], own, i)):
                                out[name].append(value)
                rows = batch(arrow, out)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], vector.take(rows.column("row"))], names=[*arrow.names[:-1], "embedding"])

    kind = reps.schema["embedding"].dataType.simpleString()
    dealt = in_arrow(reps.select("embedding", "rep", "copies"), deal, f"dim int, cell long, i int, j int, role tinyint, rep long, copies long, home long, cells array<long>, embedding {kind}")
    links = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def compare(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([batch(links, _task_links(rows, threshold))])

    found = stored(dealt.groupBy("dim", "cell", "i", "j").applyInArrow(compare, "rep long, links long, low long"), "vector-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    sized = reps.select("key", "rep", "copies").join(linked, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    result = stored(sized.select(F.col("key").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "vector-groups")
    out = rows.select("vec_id", "key").join(result, F.col("key") == F.col("of"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
