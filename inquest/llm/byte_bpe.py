"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch are laid end to end as code points. A table gives each code
point its class; the next characters refine it (the last white space before a
word, an apostrophe that opens a contraction, the first character of a text).
Each refined class is a function from the tokenizer's open-token state to the
next. These functions form a small finite monoid, so composing them is one
table lookup, and the states of all positions come from an associative scan:
compose inside blocks, compose the block totals, then replay each block from
its incoming state. Boundaries are where (state, class) opens a new token.
The slices between boundaries go through a bounded cache; those not in it are merged
pair by pair, all slices of a length together.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from inquest.llm.common import in_arrow, slices, text_of

# The White_Space code points and the contractions of the pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "sdmt", ("ll", "ve", "re")

CLOSED, LETTERS, NUMBERS, OTHERS, SPACES, PREFIX, ONE_MORE, TWO_MORE = range(8)
L, N, O, W, W_LAST, BLANK_LAST, APOS_SHORT, APOS_LONG = range(8)
FIRST = 8  # added to the class of the first code point of a text


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token opens at a character of this class."""
    if kind >= FIRST:
        return _step(CLOSED, kind - FIRST)
    if kind == L:
        if state in (ONE_MORE, TWO_MORE):
            return (CLOSED if state == ONE_MORE else ONE_MORE), False
        return LETTERS, state not in (LETTERS, PREFIX)
    if kind == N:
        return NUMBERS, state not in (NUMBERS, PREFIX)
    if kind in (O, APOS_SHORT, APOS_LONG):
        if state in (OTHERS, PREFIX) or kind == O:
            return OTHERS, state not in (OTHERS, PREFIX)
        return (ONE_MORE if kind == APOS_SHORT else TWO_MORE), True
    if kind == W:
        return SPACES, state != SPACES
    return (PREFIX if kind == BLANK_LAST else CLOSED), True


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function, class) -> function; function -> state by incoming state; (state, class) -> state; (state, class) -> opens."""
    steps = [[_step(s, k) for k in range(16)] for s in range(8)]
    move = np.array([[x[0] for x in row] for row in steps], np.uint8)
    opens = np.array([[x[1] for x in row] for row in steps], bool)
    known, todo, then = {tuple(range(8)): 0}, [tuple(range(8))], []
    while len(then) < len(todo):
        f, row = todo[len(then)], []
        for k in range(16):
            g = tuple(int(move[s, k]) for s in f)
            if g not in known:
                known[g] = len(known)
                todo.append(g)
            row.append(known[g])
        then.append(row)
    return np.array(then, np.uint16), np.array(todo, np.uint8), move, opens


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point by its general category."""
    kinds = np.full(0x110000, O, np.uint8)
    first = {"L": L, "N": N}
    for cp in range(0x110000):
        kind = first.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            kinds[cp] = kind
    kinds[WHITE] = W
    return kinds


def boundaries(text: str, firsts: np.ndarray, block: int = 256) -> np.ndarray:
    """Sorted positions at which a token opens, for texts laid end to end that begin at `firsts`."""
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _classes()[cps]
    first = np.zeros(n + 3, bool)
    first[firsts[firsts < n]] = True
    first[n:] = True
    # The last white space before a word of the same text.
    white = kinds == W
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    kinds[last] = W_LAST
    kinds[last & (cps == 0x20)] = BLANK_LAST
    for i in np.flatnonzero(cps == 0x27).tolist():
        if not first[i + 1]:
            if text[i + 1] in SHORT:
                kinds[i] = APOS_SHORT
            elif not first[i + 2] and text[i + 1 : i + 3] in LONG:
                kinds[i] = APOS_LONG
    kinds[first[:n]] += FIRST
    then, acts, move, opens = _machine()
    rows = -(-n // block)
    grid = np.full(rows * block, W, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    total = np.zeros(rows, np.uint16)
    flat = then.ravel()
    for column in grid:
        total = flat[(total.astype(np.uint32) << 4) | column]
    states, state = np.empty(rows, np.uint8), CLOSED
    for i, f in enumerate(total.tolist()):
        states[i] = state
        state = acts[f, state]
    begin = np.empty(grid.shape, bool)
    flat_move, flat_opens = move.ravel(), opens.ravel()
    for j, column in enumerate(grid):
        at = (states << 4) | column
        begin[j] = flat_opens[at]
        states = flat_move[at]
    return np.flatnonzero(begin.T.ravel()[:n])


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of single bytes, keys, joined ids): an open-addressed table of the id pairs whose bytes together are a token."""
    ranks = vocabulary(path)
    keys, joined = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                joined.append(rank)
    keys, joined = np.array(keys, np.uint64), np.array(joined, np.int64)
    size = 1 << max(4, int(len(keys) * 3).bit_length())
    table, value = np.full(size, NO_PAIR, np.uint64), np.full(size, NONE, np.int64)
    at, left = _slot(keys, size), np.arange(len(keys))
    while len(left):
        free = left[table[at[left]] == NO_PAIR]
        _, one = np.unique(at[free], return_index=True)
        table[at[free[one]]], value[at[free[one]]] = keys[free[one]], joined[free[one]]
        left = left[table[at[left]] != keys[left]]
        at[left] = (at[left] + 1) & (size - 1)
    return np.array([ranks.get(bytes([i]), NONE) for i in range(256)], np.int64), table, value


NONE = 1 << 40
NO_PAIR = np.uint64(2**64 - 1)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _joined(a: np.ndarray, b: np.ndarray, table: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The token that each pair of ids makes, or NONE."""
    keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    keys[(a < 0) | (b < 0)] = NO_PAIR - np.uint64(1)
    out = np.full(len(keys), NONE, np.int64)
    at, left = _slot(keys, len(table)), np.arange(len(keys))
    while len(left):
        found = table[at[left]]
        hit = found == keys[left]
        out[left[hit]] = value[at[left[hit]]]
        left = left[~hit & (found != NO_PAIR)]
        at[left] = (at[left] + 1) & (len(table) - 1)
    return out


def merge_many(pieces: list[bytes], path: str) -> list[bytes]:
    """The ids of slices as little-endian 32-bit bytes: every round joins the lowest pair of every slice of a length at once.

    Slices of over 64 bytes are merged one by one.
    """
    ranks = vocabulary(path)
    single, table, value = _pairs(path)
    out: list[bytes] = [b""] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        if (whole := ranks.get(p)) is not None:
            out[k] = whole.to_bytes(4, "little")
        elif len(p) > 64:
            out[k] = np.array(_merge_long(p, ranks), "<u4").tobytes()
        else:
            by_size.setdefault(len(p), []).append(k)
    for n, rows in by_size.items():
        parts = single[np.frombuffer(b"".join([pieces[k] for k in rows]), np.uint8).reshape(-1, n)]
        lowest = _joined(parts[:, :-1].ravel(), parts[:, 1:].ravel(), table, value).reshape(-1, n - 1)
        owner = np.array(rows)
        while len(owner):
            best = lowest.argmin(1)
            line = np.arange(len(owner))
            token = lowest[line, best]
            done = token == NONE
            if done.any():
                coded = parts[done].astype("<u4")
                for k, row in zip(owner[done].tolist(), coded):
                    out[k] = row.tobytes()
                parts, lowest, owner, best, token = parts[~done], lowest[~done], owner[~done], best[~done], token[~done]
                line = line[: len(owner)]
            width = parts.shape[1] - 1
            if not len(owner):
                break
            if width == 1:
                for k, t in zip(owner.tolist(), token.tolist()):
                    out[k] = t.to_bytes(4, "little")
                break
            at = np.arange(width)
            parts = np.take_along_axis(parts, at + (at > best[:, None]), 1)
            parts[line, best] = token
            at = at[:-1]
            lowest = np.take_along_axis(lowest, at + (at >= best[:, None]), 1)
            has = best > 0
            lowest[line[has], best[has] - 1] = _joined(parts[line[has], best[has] - 1], token[has], table, value)
            has = best < width - 1
            lowest[line[has], best[has]] = _joined(token[has], parts[line[has], best[has] + 1], table, value)
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice by a heap of pairs over a linked list of parts: n log n steps for very long slices.

    The adjacent pair of lowest rank is joined first, the leftmost among equals.
    """
    n = len(piece)
    end = list(range(1, n + 1))  # part i is piece[i:end[i]]; 0 once it is joined to an earlier part
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Merged:
    """Slice -> its ids as little-endian 32-bit bytes, kept between batches while they hold under `limit` characters."""

    def __init__(self, path: str, limit: int = 3_000_000):
        self.path, self.limit, self.size = path, limit, 0
        self.ids: dict[str, bytes] = {}

    def of(self, pieces: list[str]) -> dict[str, bytes]:
        """A mapping that has all of `pieces`."""
        if self.size > self.limit:
            self.ids, self.size = {}, 0
        missing = [p for p in set(pieces) if p not in self.ids]
        self.ids.update(zip(missing, merge_many([p.encode() for p in missing], self.path)))
        self.size += sum(map(len, missing))
        return self.ids


@lru_cache(2)
def merged(path: str) -> Merged:
    return Merged(path)


@lru_cache(2)
def tokens(path: str) -> list[bytes]:
    """Token bytes by id."""
    ranks = vocabulary(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_texts(texts: list[str], path: str, offsets: bool = True) -> Iterator[tuple[bytes, ...]]:
    """For each text its ids and the code point at which each of its slices begins, both as little-endian 32-bit bytes."""
    for a, b in slices(texts):
        part = texts[a:b]
        text = "".join(part)
        ends = np.cumsum([len(t) for t in part], dtype=np.int64)
        firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        opens = boundaries(text, firsts)
        cuts = np.searchsorted(opens, np.concatenate([firsts, [len(text)]])).tolist()
        at = [*opens.tolist(), len(text)]
        pieces = [text[i:j] for i, j in zip(at, at[1:])]
        ids_of = merged(path).of(pieces).__getitem__
        for k, begin in enumerate(firsts.tolist()):
            i, j = cuts[k], cuts[k + 1]
            ids = b"".join(map(ids_of, pieces[i:j]))
            yield (ids, (opens[i:j] - begin).astype("<u4").tobytes()) if offsets else (ids,)


def _mapped(df: DataFrame, column: str, names: list[str], *makes: Callable[[list], Iterator[tuple]], without: tuple[str, ...] = ()) -> DataFrame:
    """`df` with binary columns `names` that `makes` derive batch by batch, the first from `column`, each other from the first of the columns before; columns in `without` are left out.

    All of them run in one pass, so that a task needs one Python worker, not one for each.
    """
    kept = [f for f in df.schema if f.name not in (*names, *without)]
    schema = StructType([*kept, *(StructField(n, BinaryType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, source = [], b.column(column)
            for make in makes:
                made = list(zip(*make(source.to_pylist())))
                new += [pa.array(x, pa.binary()) for x in made]
                source = new[-len(made)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *new], names=schema.names)

    return in_arrow(df, run, schema)


def _decoded(tokenizer: str) -> Callable[[list], Iterator[tuple[bytes]]]:
    def make(rows: list) -> Iterator[tuple[bytes]]:
        token = tokens(tokenizer).__getitem__
        for x in rows:
            yield (b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())),)

    return make


def encode(df: DataFrame, tokenizer: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """`df` with `ids` and `offsets`, both binary arrays of little-endian unsigned 32-bit integers.

    `ids` are the tokens of the whole text; `offsets` are the code points at which its pre-tokens begin;
    offsets=False leaves them out.
    Null and empty texts have no ids. Rows, repeated ones too, are kept as they are; existing
    columns called `ids` or `offsets` are replaced. No shuffle: a row depends on itself alone.
    """
    made = df.withColumn(text, text_of(text))
    names = ["ids", "offsets"] if offsets else ["ids"]
    return _mapped(made, text, names, lambda texts: encode_texts(texts, tokenizer, offsets))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """`df` with `decoded`, the bytes that the binary `ids` stand for (null: empty). Unknown ids raise IndexError."""
    return _mapped(df, ids, ["decoded"], _decoded(tokenizer))


def round_trip(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """`df` without its text but with `ids`, as `encode` gives them, and `decoded`, as `decode` gives it from these ids: one pass over the batches."""
    made = df.withColumn(text, text_of(text))
    return _mapped(made, text, ["ids", "decoded"], lambda texts: encode_texts(texts, tokenizer, False), _decoded(tokenizer), without=(text,))


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of its encoded and again decoded text."""
    return round_trip(docs.select("doc_id", "text"), tokenizer).select(
        F.col("doc_id").cast(LongType()).alias("doc_id"),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
