"""Bloom filters as bitmaps of fixed size, built and probed by built-in expressions.

A filter is a table of bitmaps, one for each hash function and block of
positions. Tests are broadcast joins on the block, so rows never move for
them; the size is chosen by the caller and bounded by ``MAX_BITS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of a bitmap from ``bitmap_construct_agg``.
BLOCK = 8 * 4096
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28


def bits_for(rows: int) -> int:
    """Bits for each hash function: 16 for each row, a power of two within the fixed bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, 16 * rows) - 1).bit_length()))


def positions_of(key: Column, bits: int) -> list[Column]:
    """Two hash positions of a 64-bit key that is a hash itself."""
    return [F.pmod(key, F.lit(bits)), F.pmod(F.xxhash64(key), F.lit(bits))]


def bitmaps(hits: DataFrame) -> DataFrame:
    """``k, bucket, bitmap`` of ``hits`` (k, position); tasks set bits before the shuffle, so bitmaps move and no rows."""
    at = F.col("position") + 1  # bucket numbers and bit positions count from one
    return hits.groupBy("k", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def positions(rows: DataFrame, places: Sequence[Column]) -> DataFrame:
    """``k, position``: the positions of every row, a row for each hash function."""
    return rows.select(F.posexplode(F.array(*places)).alias("k", "position")).where("position is not null")


def flagged(rows: DataFrame, places: Sequence[Column], maps: DataFrame, flag: str) -> DataFrame:
    """``rows`` plus ``flag``: false only if one of its positions is not set. ``maps`` has at most ``MAX_BITS`` bits each."""
    flags = F.lit(True)
    for k, place in enumerate(places):
        side = maps.where(F.col("k") == k).select(F.col("bucket").alias(f"__fl_b{k}"), F.col("bitmap").alias(f"__fl_m{k}"))
        rows = rows.join(F.broadcast(side), (F.floor(place / BLOCK) + 1) == F.col(f"__fl_b{k}"), "left")
        bit = F.pmod(place, F.lit(BLOCK)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"__fl_m{k}"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        flags = flags & F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    return rows.withColumn(flag, flags).drop(*[f"__fl_{x}{k}" for k in range(len(places)) for x in "bm"])


def members(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A filter of the distinct 64-bit ``key`` values of a written table, and its bits."""
    bits = bits_for(keys.count())  # from Parquet footers
    return written(bitmaps(positions(keys, positions_of(F.col(key), bits))), "bloom"), bits


def without(rows: DataFrame, keys: Sequence[Column], own: DataFrame, leave: DataFrame) -> DataFrame:
    """``rows`` except those whose ``keys`` are in ``leave``, without moving rows that stay or that leave.

    ``own`` and ``leave`` are written tables of key columns, named alike: the
    keys of all rows and those that go. Null keys never leave. A filter of the
    leaving keys lets the others pass; the few keys that it stops by mistake
    are found among the keys alone, and only their rows move.
    """
    names = own.columns
    hashed = [F.xxhash64(*table) for table in ([F.col(f"`{n}`") for n in names], keys)]
    known = F.lit(True)
    for key in keys:
        known = known & key.isNotNull()
    maps, bits = members(written(leave.select(hashed[0].alias("hash")).distinct(), "leave"), "hash")
    stopped = flagged(own, positions_of(hashed[0], bits), maps, "__fl_stopped").where("__fl_stopped").select(*names).distinct()
    spared = written(stopped.join(leave, names, "left_anti").select(hashed[0].alias("__fl_spared"), *[F.col(n).alias(f"__fl_{n}") for n in names]), "spared")
    hashed_rows = rows.withColumn("__fl_row_hash", F.when(known, hashed[1]))  # made once, below the joins
    marked = flagged(hashed_rows, positions_of(F.col("__fl_row_hash"), bits), maps, "__fl_stopped").withColumn("__fl_stopped", F.col("__fl_stopped") & F.col("__fl_row_hash").isNotNull())
    kept = marked.where("not __fl_stopped").select(*[F.col(f"`{c}`") for c in rows.columns])
    spared_maps, spared_bits = members(spared, "__fl_spared")
    again = flagged(marked.where("__fl_stopped"), positions_of(F.col("__fl_row_hash"), spared_bits), spared_maps, "__fl_again").where("__fl_again")
    same = F.lit(True)
    for key, n in zip(keys, names):
        same = same & (key == F.col(f"__fl_{n}"))
    return kept.unionByName(again.join(spared, same, "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns]))
