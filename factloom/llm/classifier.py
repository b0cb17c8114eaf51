"""Operator 10: quality classifier, a logistic regression on hashed word n-grams.

Features are counts of words, word pairs and n-grams of word shapes (letter
case, signs at the end, whether the word repeats the one before), hashed to
``2 ** bits`` weights and scaled to unit length. Weights are trained by
follow-the-regularised-leader updates over a bounded sample of labelled rows,
then every whole text is scored as a sparse dot product.

Defined results: null and empty texts have no features and score the bias;
rows with a null label or a null doc_id don't train; rows without doc_id
count as held out; a doc_id labelled twice trains with its greater label; an
empty table gives an empty result, and no labels at all the score 0.5;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs

_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CACHED_WORDS = 200_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the training sample: labelled rows with the smallest hashes of doc_id."""

    bits: int = 18
    max_rows: int = 8000
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4


class Features:
    """Turns a UTF-8 text into (feature numbers, values)."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self._numbers: dict[bytes, int] = {}

    def _number(self, word: bytes) -> int:
        """A word's hash in the high half, its shape's in the low half."""
        import zlib

        stem = word.rstrip(_SIGNS)
        case = b"-" if not stem else b"u" if stem.isupper() and len(stem) > 1 else b"t" if stem[:1].isupper() else b"l"
        shape = case + bytes(sorted(set(word[len(stem) :]))) + (b"." if stem.strip(_SIGNS) != stem else b"")
        return zlib.crc32(word.lower()) << 32 | zlib.crc32(shape)

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = raw.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float64)
        numbers, number = self._numbers, self._number
        if len(numbers) > _CACHED_WORDS:
            numbers.clear()
        packed = np.empty(len(words), np.uint64)
        for i, word in enumerate(words):
            n = numbers.get(word)
            if n is None:
                n = numbers[word] = number(word)
            packed[i] = n
        word, shape = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
        shape[1:] ^= (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(33)
        a, b, c = _MIX
        grams = [word * a, (word[:-1] * b + word[1:]) * a, shape * c, (shape[:-1] * a + shape[1:]) * c, (shape[:-2] * b + shape[1:-1] * a + shape[2:]) * c]
        ids, counts = np.unique(np.concatenate(grams) >> self.shift, return_counts=True)
        values = counts.astype(np.float64)
        return ids.astype(np.int64), values / np.sqrt(values @ values)


@dataclass(frozen=True)
class Model:
    """Weights, ``2 ** bits`` of them, and the bias."""

    weights: np.ndarray
    bias: float
    bits: int

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[ids] @ values + self.bias, -35, 35))))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """FTRL-Proximal (McMahan et al., 2013) over the examples in their order, ``epochs`` times."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * settings.l1 - zi
        return np.where(np.abs(zi) <= settings.l1, 0.0, shrunk / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2))

    for _ in range(settings.epochs):
        for ids, values, label in examples:
            ids, values = np.append(ids, size), np.append(values, 1.0)
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            gradient = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            squared = gradient * gradient
            z[ids] = zi + gradient - (np.sqrt(ni + squared) - np.sqrt(ni)) / settings.alpha * w
            n[ids] = ni + squared
    w = weights(z, n)
    return Model(w[:size].astype(np.float32), float(w[size]), settings.bits)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; 0 is held out. Null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality") -> Model:
    """Train on at most ``max_rows`` labelled rows outside the held-out fold, chosen and ordered by hash."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # max_rows small rows
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(settings.max_rows)
    sample = texts.select("text", "label").toArrow()
    features = Features(settings.bits)
    examples = [(*features.of(raw), y) for raw, y in zip(blobs(sample.column("text")), sample.column("label").to_pylist())]
    return train(examples, settings)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, score, predicted."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.bits)
        for batch in batches:
            scores = [model.score(*features.of(raw)) for raw in blobs(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    scored = rows.mapInArrow(each, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
