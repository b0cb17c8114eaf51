"""Operator 2: quality rules by compression bands.

Repetitive text compresses far better than prose of its length, and text
without structure (encoded binaries, random keys) hardly compresses. The
zstandard ratio of a whole document is held against a band that depends on
its length, since short texts compress worse; fixed chunks are held against
one band, so that a repetitive stretch of a long document counts too.

Defined results: null text has no words and fails the base rule; empty text
likewise; texts of any length are read whole; null doc_ids and repeated rows are judged like any row; an empty
table gives an empty result; columns whose names clash with a result column
are kept by ``keep_clean`` and ignored by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_COLUMNS = [
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("ratio", pa.float64()),
    ("n_chunks", pa.int64()),
    ("n_bad_chunks", pa.int64()),
]
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio (bytes in, bytes out) at zstandard ``level``.

    ``by_length``: (least bytes, lowest ratio, highest ratio), ascending. Prose
    compresses better the longer it is, and its highest ratios stay close
    together at any one length; the highest ratios here lie about two per cent
    above those of documents labelled good, the lowest ones well below.
    ``chunk_band`` holds for every chunk of ``chunk_bytes``, the last one ending
    with the text; shorter texts have none. A document fails when more than
    ``bad_chunk_share`` of its chunks lie outside.
    """

    by_length: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 3.0),
        (64, 0.75, 2.0),
        (128, 0.9, 2.0),
        (256, 1.05, 1.98),
        (512, 1.2, 2.07),
        (1024, 1.35, 2.21),
        (2048, 1.4, 2.28),
        (4096, 1.4, 2.4),
        (8192, 1.4, 2.47),
        (16384, 1.4, 2.54),
        (32768, 1.4, 2.6),
        (65536, 1.4, 2.8),
        (1 << 18, 1.4, 3.1),
        (1 << 20, 1.4, 3.5),
    )
    chunk_bytes: int = 4096
    chunk_band: tuple[float, float] = (1.35, 2.32)
    bad_chunk_share: float = 0.25
    level: int = 3


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = raw.split()  # by exactly these six white-space bytes
    n = len(words)
    chars = len(raw.translate(None, _SPACE + _CONTINUED))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    if len(number) == n:
        return 0
    v = len(number)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # else the three numbers fit one integer
        pairs, v = np.unique(pairs, return_inverse=True)[1], max(v, n)
    windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def compression_verdict(raw: bytes, compressor, bands: Bands) -> tuple[bool, float, int, int]:
    """Whether the bands accept a text, its ratio, its chunks and those outside the band."""
    if not raw:
        return True, 1.0, 0, 0
    ratio = len(raw) / len(compressor.compress(raw))
    _, low, high = next(b for b in reversed(bands.by_length) if len(raw) >= b[0])
    size, (least, most) = bands.chunk_bytes, bands.chunk_band
    starts = list(range(0, len(raw) - size + 1, size))
    if starts and len(raw) % size:
        starts.append(len(raw) - size)  # the rest, in a chunk that ends with the text
    bad = sum(not least <= size / len(compressor.compress(raw[at : at + size])) <= most for at in starts)
    return low <= ratio <= high and bad <= bands.bad_chunk_share * len(starts), ratio, len(starts), bad


def _judged(bands: Bands):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            rows = []
            for raw in blobs(batch.column("text")):
                counts = base_counts(raw)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                good, ratio, chunks, bad = compression_verdict(raw, compressor, bands)
                rows.append((*counts, failed, good and not failed, ratio, chunks, bad))
            columns = zip(*rows) if rows else [()] * (len(_COLUMNS) - 1)
            arrays = [batch.column("doc_id"), *(pa.array(x, kind) for x, (_, kind) in zip(columns, _COLUMNS[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _COLUMNS])

    return judge


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its counts, base verdict, compression figures and verdict."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judged(bands), _SCHEMA)


def keep_clean(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass and no shuffle."""
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            kept = []
            for raw in blobs(batch.column("text")):
                n, *_, repeated = base_counts(raw)
                kept.append(n >= 50 and 100 * repeated <= 50 * n and compression_verdict(raw, compressor, bands)[0])
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, schema)
