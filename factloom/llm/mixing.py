"""Operator 6: mixing sources to target weights by iterative proportional fitting.

Token totals of (source, lang, topic) cells are raked to target shares of
each margin in turn, under a cap of one on every cell's probability, since a
document can be drawn once at most. Documents are then drawn by their cell's
calibrated probability and a hash of their id, so a draw can be repeated.

A margin's target is either given shares by value or an exponent ``t``: the
share of a value is then in proportion to its tokens to the power ``t``
(1 leaves the mix as it is, 0 makes all values equal). Topics are buckets of
a locality-sensitive hash over a document's frequent words: documents with a
like vocabulary share a bucket.

Cells are collected only up to ``MAX_CELLS``; more of them are raked in Spark
by the same rounds.

Defined results: null source or lang is the value ''; null and empty texts
have topic 0 and the length of the end id; rows without doc_id are drawn by
the hash of their text; repeated rows are drawn or left together, and so are
rows that share doc_id and text; texts of any length are measured whole; an empty table gives an empty result; further columns ride along in ``sample``.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import strings, written
from .tokens import encoder

MARGINS = ("source", "lang", "topic")
MAX_CELLS = 100_000
_TOPIC_BITS = 3
_NO_ID = -(1 << 63)
_TOPIC_WORDS = 24
_SALTS = 16
#: Texts that are Python strings at a time.
_ROWS = 500


@dataclass(frozen=True)
class Mix:
    """``keep``: share of all tokens that the draw aims at. Margins: shares by value, or an exponent."""

    keep: float = 0.6
    source: dict[str, float] | float = 0.7
    lang: dict[str, float] | float = 0.8
    topic: dict[int, float] | float = 0.5
    rounds: int = 40
    seed: int = 6


def topic_of(text: str) -> int:
    """Bucket of a document: signs of its frequent words' hash bits, each weighed by its count."""
    counts = Counter(text.split())
    common = [(n, w) for w, n in counts.items() if n > 1 and len(w) > 3]
    if len(common) < _TOPIC_WORDS:  # words that occur once come after all others, and are compared as plain words
        common += [(1, w) for w in heapq.nlargest(_TOPIC_WORDS - len(common), [w for w, n in counts.items() if n == 1 and len(w) > 3])]
    else:
        common = heapq.nlargest(_TOPIC_WORDS, common)
    sums = [0] * _TOPIC_BITS
    for n, word in common:
        h = zlib.crc32(word.encode("utf-8", "replace"))
        for k in range(_TOPIC_BITS):
            sums[k] += n if h >> k & 1 else -n
    return sum(1 << k for k in range(_TOPIC_BITS) if sums[k] > 0)


def measured(docs: DataFrame, tokenizer: str, seed: int, *carried: str, lean: bool = False) -> DataFrame:
    """``doc_id, source, lang, u, topic, n_tokens`` of all rows, and 64-bit columns that are ``carried`` along; u is the row's uniform hash."""
    columns = ["doc_id", "source", "lang", "u", *carried]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, lean)
        for batch in batches:
            text = batch.column("text")
            topics = pa.array([topic_of(t) for at in range(0, len(text), _ROWS) for t in strings(text.slice(at, _ROWS))], pa.int32())
            counts = [np.diff(offsets) + 1 for _, offsets in enc.encode_column(text, counts_only=True)]
            lengths = pa.array(np.concatenate(counts) if counts else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), topics, lengths], names=[*columns, "topic", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[_value(c).alias(c) for c in ("source", "lang")], uniform(seed).alias("u"), *carried, "text")
    return rows.mapInArrow(measure, "doc_id long, source string, lang string, u double, " + "".join(f"{c} long, " for c in carried) + "topic int, n_tokens long")


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def uniform(seed: int) -> Column:
    """Between 0 and 1, by a hash of doc_id, or of the text where there is none."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.coalesce("text", F.lit(""))))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def _shares(target: dict | float, tokens: dict) -> dict:
    """Target shares of the values that occur, which sum to one."""
    raw = {v: float(target.get(v, 0.0)) if isinstance(target, dict) else float(n) ** target for v, n in tokens.items()}
    total = sum(raw.values())
    return {v: x / total if total else 0.0 for v, x in raw.items()}


def rake(cells: list[tuple], tokens: np.ndarray, mix: Mix) -> np.ndarray:
    """Probability of each (source, lang, topic) cell: margins fitted in turn, at most one each."""
    weight, aim = np.full(len(cells), mix.keep), mix.keep * tokens.sum()
    if not cells:
        return weight
    fits = []
    for k, name in enumerate(MARGINS):
        values = sorted({c[k] for c in cells})
        number = {v: i for i, v in enumerate(values)}
        index = np.array([number[c[k]] for c in cells])
        have = np.bincount(index, tokens, len(values))
        shares = _shares(getattr(mix, name), dict(zip(values, have)))
        fits.append((index, np.array([shares[v] for v in values]) * aim))
    for _ in range(mix.rounds):
        for index, wanted in fits:
            have = np.bincount(index, tokens * weight, len(wanted))
            weight = np.minimum(1.0, weight * np.divide(wanted, have, out=np.zeros_like(wanted), where=have > 0)[index])
    return weight


def rake_in_spark(cells: DataFrame, mix: Mix) -> DataFrame:
    """The same rounds over more cells than the driver takes; ``cells``: the margins and tokens."""
    total = cells.agg(F.sum("tokens").alias("n")).first().n or 0
    state = cells.withColumn("probability", F.lit(float(mix.keep)))
    for _ in range(mix.rounds):
        for name in MARGINS:
            target = getattr(mix, name)
            if isinstance(target, dict):
                known = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])
                raw = F.coalesce(F.try_element_at(known, F.col(name)), F.lit(0.0))
            else:
                raw = F.pow("had", F.lit(float(target)))
            sums = state.groupBy(name).agg(F.sum("tokens").alias("had"), F.sum(F.col("tokens") * F.col("probability")).alias("has")).withColumn("raw", raw)
            whole = sums.agg(F.sum("raw").alias("whole"))
            factor = F.when(F.col("has") > 0, F.col("raw") / F.col("whole") * (mix.keep * total) / F.col("has")).otherwise(0.0)
            factors = sums.join(F.broadcast(whole)).select(name, factor.alias("factor"))
            state = state.join(factors, name).withColumn("probability", F.least(F.lit(1.0), F.col("probability") * F.col("factor"))).drop("factor")
        state = written(state, "cells")
    return state


def calibrated(rows: DataFrame, mix: Mix, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """``source, lang, topic, tokens, probability`` of all cells, and whether they are few enough to broadcast."""
    spark = rows.sparkSession
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if cells.count() > max_cells:
        return rake_in_spark(cells, mix), False
    found = sorted(tuple(r) for r in cells.collect())
    weights = rake([r[:3] for r in found], np.array([r[3] for r in found], float), mix)
    return spark.createDataFrame([(*r, float(w)) for r, w in zip(found, weights)], "source string, lang string, topic int, tokens long, probability double"), True


def draw(docs: DataFrame, tokenizer: str, mix: Mix = Mix(), max_cells: int = MAX_CELLS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source, lang): its cell, n_tokens, probability and whether it is drawn."""
    drawn = _drawn(written(measured(docs, tokenizer, mix.seed), "measured"), mix, max_cells)
    return drawn.select("doc_id", *MARGINS, "n_tokens", "probability", "drawn")


def _drawn(rows: DataFrame, mix: Mix, max_cells: int) -> DataFrame:
    """``rows`` as measured, a table, with the probability of their cell and whether they are drawn."""
    cells, few = calibrated(rows, mix, max_cells)
    cells = cells.drop("tokens")
    if few:
        joined = rows.join(F.broadcast(cells), list(MARGINS))
    else:  # a hot cell's rows are dealt over several tasks
        salted = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = rows.withColumn("salt", F.floor(F.col("u") * _SALTS).cast("int")).join(salted, [*MARGINS, "salt"])
    return joined.withColumn("drawn", F.col("u") < F.col("probability"))


def sample(docs: DataFrame, tokenizer: str, mix: Mix = Mix(), max_cells: int = MAX_CELLS, lean: bool = False) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns; texts are measured once, and neither drawn nor other rows move. ``lean`` is the encoder's."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.xxhash64("text")]
    rows = written(measured(docs.withColumn("__fl_text_id", key[1]), tokenizer, mix.seed, "__fl_text_id", lean=lean), "measured")
    judged = _drawn(rows, mix, max_cells).select(key[0].alias("id"), F.col("__fl_text_id").alias("text_id"), "drawn")
    judged = written(judged, "drawn")
    return bloom.without(docs, key, judged.select("id", "text_id"), written(judged.where("not drawn").select("id", "text_id").distinct(), "leave"))
