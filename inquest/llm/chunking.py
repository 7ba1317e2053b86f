"""Document fingerprints by content-defined chunking.

A gear hash over the last WINDOW bytes marks boundaries wherever the text says
so, whatever stands before, so that an insertion moves only the chunks that it
touches. Chunking is normalised: a stricter mask before the target length and a
looser one behind it keep lengths near the target. A fingerprint is the set of
the chunks' digests with their lengths; containment is weighted by length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inquest.llm.common import batch, in_arrow, text_of

#: Bytes of a chunk: shortest, target and longest; bits that must be zero before and behind the target.
SHORTEST, TARGET, LONGEST, STRICT_BITS, LOOSE_BITS = 8, 32, 128, 6, 3
#: Bytes that a gear hash looks back on; a power of two.
WINDOW = 16
#: Documents in a bucket of neighbouring ids, and the most buckets.
BUCKET_DOCS, MOST_BUCKETS = 256, 65_536


@lru_cache(1)
def _gear() -> np.ndarray:
    """A random 32-bit number for each byte, from a digest of the byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([i]), seed=7) for i in range(256)], np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the sum of the gears of the last WINDOW bytes, each shifted by its distance; windows double in log steps."""
    h = _gear()[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, width * 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of `data`."""
    n = len(data)
    h = gear_hashes(data) >> np.uint32(32 - STRICT_BITS)
    loose = np.flatnonzero(h >> np.uint32(STRICT_BITS - LOOSE_BITS) == 0) + 1
    strict = (np.flatnonzero(h[loose - 1] == 0)).tolist()
    loose_ends = loose.tolist()
    strict_ends = loose[strict].tolist()
    ends, at = [], 0
    while at < n:
        i = bisect_left(strict_ends, at + SHORTEST)
        if i < len(strict_ends) and strict_ends[i] < at + TARGET:
            at = strict_ends[i]
        else:
            i = bisect_left(loose_ends, at + TARGET)
            at = min(loose_ends[i] if i < len(loose_ends) else n, at + LONGEST, n)
        ends.append(at)
    return ends


def chunks(data: bytes) -> dict[int, int]:
    """Digest -> length of each distinct chunk."""
    out, begin, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in chunk_ends(data):
        part = data[begin:end]
        out[digest(part) >> 24] = len(part)
        begin = end
    return out


def fingerprint(found: dict[int, int]) -> str:
    """The set as text: ten hex digits of digest and two of length for each chunk, sorted."""
    return "".join(f"{d:010x}{n:02x}" for d, n in sorted(found.items()))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The length of the shared chunks over that of all chunks of the larger set: 1 for equal sets, 0 for disjoint ones; two empty sets are equal."""
    total = max(sum(a.values()), sum(b.values()))
    return sum(a[d] for d in a.keys() & b.keys()) / total if total else 1.0


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The part of `a`, by length, whose chunks are also in `b`."""
    total = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / total if total else 1.0


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `fingerprint` of each whole text (null: empty, whose fingerprint is ''). Rows stay as they are; no shuffle."""
    kept = [f for f in docs.schema if f.name not in ("fingerprint", "_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([fingerprint(chunks(t.encode())) for t in b.column("_text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), made], names=[*(f.name for f in kept), "fingerprint"])

    named = docs.select(*(f.name for f in kept), text_of(text).alias("_text"))
    return in_arrow(named, run, StructType([*kept, StructField("fingerprint", StringType())]))


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by as many first code points of the following text (or all)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _bounds(docs: DataFrame) -> tuple[list[int], int | None]:
    """Ids that part the documents into buckets of about BUCKET_DOCS, and the largest id: at most MOST_BUCKETS numbers."""
    n, largest = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    parts = min(MOST_BUCKETS, n // BUCKET_DOCS)
    if parts < 2:
        return [], largest
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * parts)).first()[0]
    return sorted({x for x in found if x < largest}), largest


def _in_buckets(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` with `bucket` and `guest`, neighbouring ids in one bucket, larger ids first.

    Bounds are ids of documents, so the document with a bound's id is the first of its bucket: it also goes, as a guest,
    to the bucket of the next larger ids, whose last document it follows. The first of all is a guest of the last bucket.
    """
    bounds, largest = _bounds(docs)
    at = np.array(bounds, np.int64)
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("bucket", pa.int32()), ("guest", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = np.where(null, 0, np.searchsorted(at, value)).astype(np.int32)
            yield batch(arrow, {"doc_id": ids, "text": b.column("text"), "bucket": bucket, "guest": np.zeros(len(ids), bool)})
            first = np.flatnonzero(~null & (np.isin(value, at) | (value == (largest if largest is not None else 0))))
            if len(first):
                place = np.where(value[first] == largest, 0, bucket[first] + 1).astype(np.int32)
                some = b.take(pa.array(first))
                yield batch(arrow, {"doc_id": some.column("doc_id"), "text": some.column("text"), "bucket": place, "guest": np.ones(len(first), bool)})

    return in_arrow(docs, run, "doc_id long, text string, bucket int, guest boolean")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how much they are like each other and the next document's.

    docs: doc_id, text. The next document is the one with the next smaller doc_id (nulls come last, rows with equal ids
    by text), after the last the first; a table of one row is followed by itself. Null texts are empty. Returns a row for
    each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Texts cross the network once, dealt by bucket and sorted inside partitions.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    dealt = _in_buckets(docs).repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    fields += [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    arrow = pa.schema(fields)

    def row(doc_id: int | None, text: str, own: dict, following: str, their: dict) -> tuple:
        changed = edited(text, following).encode()
        new = chunks(changed)
        sha = hashlib.sha256(changed).hexdigest()
        return doc_id, len(text), sha, fingerprint(own), fingerprint(new), likeness(own, new), likeness(own, their)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket, begin, done, size = None, None, None, [], 0
        for b in batches:
            for doc_id, text, place, guest in zip(*(b.column(i).to_pylist() for i in range(4))):
                if place != bucket:
                    if last is not None:  # the only bucket without a guest has null ids alone: it follows itself
                        done.append(row(*last, *begin[1:]))
                    last, bucket, begin = None, place, None
                if guest and last is None:
                    continue
                own = chunks(text.encode())
                if begin is None:
                    begin = (doc_id, text, own)
                if last is not None:
                    done.append(row(*last, text, own))
                    size += len(text)
                last = None if guest else (doc_id, text, own)
                if size > 4_000_000:
                    yield batch(arrow, {k: [d[i] for d in done] for i, (k, _) in enumerate(fields)})
                    done, size = [], 0
        if last is not None:
            done.append(row(*last, *begin[1:]))
        if done:
            yield batch(arrow, {k: [d[i] for d in done] for i, (k, _) in enumerate(fields)})

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_arrow(dealt, run, schema)
