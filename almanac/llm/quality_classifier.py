"""Quality classifier: similarity-weighted votes of nearest labelled neighbours in a latent-semantic space.

A text becomes hashed counts of its words, of their shapes (case, digits and symbols, with runs collapsed) and of how
far words and lines repeat; counts are damped, weighted by rarity and projected on the leading singular vectors of a
labelled sample. The sample's vectors are broadcast: they number at most FIT_ROWS, whatever the input. Every document
is compared with all of them by blocked exact cosine products, and its NEIGHBOURS nearest ones vote.

Edge cases: a null or empty text has the zero vector and scores the sample's mean label; labels without a row, and
rows without a label, play no part; a document labelled more than once counts with its largest label; without any
usable label every score is 0.5 and ``keep_good`` keeps every row; of rows that repeat a labelled id one, that of the
smallest counts, is learned from; equal texts score equally; an empty table gives an empty result; extra columns are
ignored by ``score_documents`` and kept by ``keep_good``.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import by_slices

#: Labelled rows that a fit uses at most: those whose hashed ids are smallest.
FIT_ROWS = 2048
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 6
THRESHOLD = 0.7
#: Blocks of documents whose products are taken together.
BLOCK = 256

_WORDS, _SHAPES, _STEPS = 4096, 512, 21
DIMENSIONS = _WORDS + _SHAPES + 4 * _STEPS
_CLASSES = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+")
_KEEP_WORDS = 100_000
_places: dict[bytes, tuple[int, int]] = {}


def _place(word: bytes) -> tuple[int, int]:
    shape = _RUN.sub(rb"\1", word.translate(_CLASSES))
    found = zlib.crc32(word.lower()) % _WORDS, _WORDS + zlib.crc32(shape) % _SHAPES
    if len(_places) > _KEEP_WORDS:
        _places.clear()
    _places[word] = found
    return found


def _step(share: float) -> int:
    return min(_STEPS - 1, int(share * (_STEPS - 1)))


def text_counts(texts: list[str | None]) -> np.ndarray:
    """Damped counts, one row a text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts):
        raw = (text or "").encode()
        words = raw.split()
        if not words:
            continue
        counts = Counter(words)
        found = [_places.get(w) or _place(w) for w in counts]
        n = np.fromiter(counts.values(), np.float32, len(counts))
        places = np.array(found)
        row[:_WORDS] = np.bincount(places[:, 0], n, _WORDS)
        row[_WORDS : _WORDS + _SHAPES] = np.bincount(places[:, 1] - _WORDS, n, _SHAPES)
        row[:] = np.log1p(row)
        row[_WORDS : _WORDS + _SHAPES] = np.log1p(np.bincount(places[:, 1] - _WORDS, n, _SHAPES) * (100 / len(words)))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        base = _WORDS + _SHAPES
        row[base + _step(1 - len(counts) / len(words))] = 3
        row[base + _STEPS + _step(1 - len(set(lines)) / len(lines))] = 3
        row[base + 3 * _STEPS + _step(sum(map(operator.eq, words, words[1:])) / len(words))] = 3
        row[base + 2 * _STEPS + min(_STEPS - 1, len(words).bit_length())] = 1
    return out


#: Whole numbers for one: rarities, axes and vectors are rounded to these fractions, so that sums of products are exact
#: in doubles (below 2 ** 53) and a text scores the same whatever else its block holds.
_RARITY_ONE, _AXIS_ONE, _VECTOR_ONE = 1 << 12, 1 << 20, 1 << 20


def _whole(x: np.ndarray, one: int) -> np.ndarray:
    return np.rint(np.asarray(x, np.float64) * one)


@dataclass
class Model:
    rarity: np.ndarray  # per dimension, in whole numbers of 1 / _RARITY_ONE
    axes: np.ndarray  # dimensions x rank, in whole numbers of 1 / _AXIS_ONE
    vectors: np.ndarray  # labelled rows x rank, unit length, in whole numbers of 1 / _VECTOR_ONE
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
        n = len(counts)
        rarity = np.log((1 + n) / (1 + (counts > 0).sum(0))) + 0.3
        x = _unit((counts * rarity).astype(np.float32))
        values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
        order = np.argsort(values)[::-1][:rank]
        order = order[values[order] > 1e-9]
        model = cls(_whole(rarity, _RARITY_ONE), _whole(x.T @ left[:, order] / np.sqrt(values[order]), _AXIS_ONE), np.zeros((0, len(order))), labels.astype(np.float64))
        model.vectors = np.concatenate([model.project(counts[lo : lo + BLOCK]) for lo in range(0, n, BLOCK)])
        return model

    def project(self, counts: np.ndarray) -> np.ndarray:
        """The texts' vectors, in whole numbers of 1 / _VECTOR_ONE."""
        return _whole(_unit(np.rint(counts * self.rarity) @ self.axes), _VECTOR_ONE)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        prior = float(self.labels.mean())
        cosine = self.project(counts) @ self.vectors.T / _VECTOR_ONE**2
        k = min(neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS
        total = weight.sum(1)
        return np.where(total > 1e-9, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-9), prior)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are never learned from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents outside the held-out fold; only these reach the driver."""
    usable = labels.filter(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    usable = usable.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels without a row take no place
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` small rows

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                counts = text_counts(part.column(0).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in counts], pa.binary()), part.column(1), part.column(2)], names=["counts", "label", "doc_id"])

    # rows that repeat a labelled id are as one, that of the smallest counts: never more than ``rows`` reach the driver
    got = sample.select("text", "label", "doc_id").mapInArrow(run, f"counts binary, label double, doc_id {kind}")
    got = got.groupBy("doc_id").agg(F.min("counts").alias("counts"), F.first("label").alias("label")).select("counts", "label").collect()
    got.sort()
    counts = np.array([np.frombuffer(x["counts"], np.float16) for x in got], np.float32).reshape(len(got), DIMENSIONS)
    return Model.fit(counts, np.array([x["label"] for x in got])) if got else Model(np.ones(DIMENSIONS), np.zeros((DIMENSIONS, 1)), np.zeros((0, 1)), np.zeros(0))


def _scorer(model: Model, spark):
    shared = spark.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> np.ndarray:
        own = shared.value
        parts = [own.score(text_counts(texts[lo : lo + BLOCK])) for lo in range(0, len(texts), BLOCK)]
        return np.concatenate(parts).clip(0, 1) if parts else np.zeros(0)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    score = _scorer(fit_model(docs, labels), docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = pa.array(score(batch.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), got], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, reject_below: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``reject_below``; all without usable labels."""
    model = fit_model(docs, labels)
    if not len(model.labels):
        return docs
    score = _scorer(model, docs.sparkSession)
    at = docs.columns.index("text")

    def good(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(score(part.column(at).to_pylist()) >= reject_below))

    return docs.mapInArrow(lambda batches: by_slices(batches, good, BLOCK), docs.schema)
