"""Quality classifier by compression.

Two Zstandard dictionaries are trained, one on good and one on bad labelled
texts. A text goes through both, block by block so that the dictionaries and
not the text's own repetitions decide; the difference of the compressed sizes,
normalised by the text's and by the compressed length, with the compressed
share itself, is mapped to a score by logistic regression on labelled texts
that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from inquest.llm.common import in_arrow, some_rows, text_of

#: Labelled texts used, per class, for the dictionaries and for the calibration, and the characters of each that are read: bounds of the fit.
DICTIONARY_TEXTS, CALIBRATION_TEXTS, FIT_CHARS = 1200, 1500, 8192
#: Bytes of a dictionary at most, and of a block.
DICTIONARY_BYTES, BLOCK = 262_144, 1024
#: A text is accepted from this score on.
THRESHOLD = 0.3
#: Labels of documents whose CRC-32 (of doc_id as text) leaves 0 by this are held out.
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """A fitted classifier: the dictionaries, and the coefficients of the standardised features. Without dictionaries the score is constant."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), 0))
        if self.mean:
            x = (features(texts, self.good, self.bad) - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -40, 40)))


@lru_cache(4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)


def features(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: size difference by length, by compressed size, and the smaller compressed share."""
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    out = np.empty((len(texts), 3))
    for k, text in enumerate(texts):
        data, a, b = text.encode(), 0, 0
        for i in range(0, max(1, len(data)), BLOCK):
            part = data[i : i + BLOCK]
            a += len(by_good(part))
            b += len(by_bad(part))
        n = max(1, len(data))
        out[k] = (a - b) / n, (a - b) / max(a, b), min(a, b) / n
    return out


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the texts themselves as raw content where they are too few to train on."""
    parts = [t.encode()[:4096] for t in texts]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 8))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:] or b"\0" * 8


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 60) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method with a small ridge."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(column: str = "doc_id") -> Column:
    """Whether a document's label is kept from the fit; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels(doc_id, quality) of documents that are not held out.

    Of each class the first DICTIONARY_TEXTS + CALIBRATION_TEXTS labelled documents by a hash of their id are read, at
    most FIT_CHARS characters of each, distinct texts only; the rest of the table is not needed. Null labels, ids and
    texts are passed over. If a class has under four texts, the score is the share of label 1 for all texts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    most = DICTIONARY_TEXTS + CALIBRATION_TEXTS
    picked = None
    for quality in (0, 1):
        one = some_rows(usable.where(F.col("quality") == quality), most, "doc_id")
        picked = one if picked is None else picked.unionByName(one)
    read = docs.where(F.col("text").isNotNull()).select("doc_id", F.substring("text", 1, FIT_CHARS).alias("text"))
    rows = read.join(F.broadcast(picked), "doc_id").select("quality", "doc_id", "text").collect()  # at most 2 * most ids
    texts: dict[int, list[str]] = {0: [], 1: []}
    for q in (0, 1):
        own = sorted({(r.doc_id, r.text) for r in rows if r.quality == q}, key=lambda r: (r[0] * 2654435761 % 2**32, r[1]))
        texts[q] = list(dict.fromkeys(t for _, t in own))
    share = (len(texts[1]) + 1) / (len(texts[0]) + len(texts[1]) + 2)
    if min(len(texts[0]), len(texts[1])) < 4:
        return Model(b"", b"", (), (), (float(np.log(share / (1 - share))),))
    cut = {q: min(DICTIONARY_TEXTS, len(texts[q]) // 2) for q in (0, 1)}
    good, bad = _dictionary(texts[1][: cut[1]]), _dictionary(texts[0][: cut[0]])
    rest = [(t, q) for q in (0, 1) for t in texts[q][cut[q] :]]
    x, y = features([t for t, _ in rest], good, bad), np.array([q for _, q in rest], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = logistic((x - mean) / scale, y)
    # The classes were drawn alike; the constant is set for their real shares.
    n = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    drawn = y.mean()
    weights[0] += np.log(n[1] / n[0]) - np.log(drawn / (1 - drawn))
    return Model(good, bad, tuple(mean), tuple(scale), tuple(weights))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score` of each whole text (0 to 1, higher is better; null is empty). Rows stay as they are; no shuffle."""
    kept = [f for f in docs.schema if f.name not in ("score", "_text")]
    # a text goes to Python once, not as it is and as it is read
    sent = any(f.name == text and isinstance(f.dataType, StringType) for f in kept)
    read = text if sent else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array(model.scores([x or "" for x in b.column(read).to_pylist()]), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), made], names=[*(f.name for f in kept), "score"])

    named = docs.select(*(f.name for f in kept), *([] if sent else [text_of(text).alias("_text")]))
    return in_arrow(named, run, StructType([*kept, StructField("score", DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    made = score(docs.select("doc_id", "text"), fit(docs, labels))
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier fitted to `labels` does not reject."""
    return score(docs, fit(docs, labels)).where(F.col("score") >= THRESHOLD).drop("score")
