"""Word shingles as 64-bit numbers, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from inquest.llm.common import slices

#: Words of a shingle.
WORDS = 5
_BYTE, _WORD = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93


def mix(h: np.ndarray, times: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(times)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words (runs without ASCII white space) of `data`, which ends in white space.

    A word is hashed as a polynomial in its bytes: a difference of running sums, shifted back by the inverse power.
    """
    b = np.frombuffer(data, np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(white, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    powers = np.full(len(b), _BYTE, np.uint64)
    powers[:1] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    back = np.full(len(b), pow(_BYTE, -1, 2**64), np.uint64)
    back[:1] = 1
    np.multiply.accumulate(back, out=back)
    return starts, mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def words_of(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, A-Z lower-cased, in order."""
    for a, b in slices(texts, 1_000_000):
        parts = [t.encode().lower() + b"\n" for t in texts[a:b]]
        starts, hashes = word_hashes(b"".join(parts))
        cuts = np.searchsorted(starts, np.cumsum([0, *map(len, parts)]))
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield hashes[i:j]


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The shingles of a word sequence in order; a shorter sequence is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(_WORD) + words[i : n - k + 1 + i]
    return mix(h)


def outer(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which rows to keep so that every key has its least and its largest value: a map-side combine that keeps the order of rows."""
    order = np.lexsort((value, key))
    edge = np.ones(len(key) + 1, bool)
    edge[1:-1] = key[order[1:]] != key[order[:-1]]
    keep = np.zeros(len(key), bool)
    keep[order[edge[:-1] | edge[1:]]] = True
    return keep
