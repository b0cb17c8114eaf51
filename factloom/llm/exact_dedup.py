"""Operator 8: exact dedup through a two-pass Bloom filter, in DataFrame operations only.

Pass one counts how often each of ``HASHES`` hash positions is hit; positions
hit twice or more form one bitmap per hash function. Pass two tests every row
against the broadcast bitmaps: a row is possibly repeated only if all its
positions were hit twice. Only those rows shuffle; the rest are unique for
certain and pass straight through. False positives shuffle too and come out
as groups of one, so the result is exact at any fill.

A bitmap has at most ``bloom.MAX_BITS`` bits. Corpora with more rows than that
is good for are split by ranges of the digest, each with bitmaps of its own,
so the share of rows that shuffle stays the same at any size. Pass one moves
two positions of eight bytes for each row, never digests or texts.

Defined results: null text equals empty text; among equal texts the largest
doc_id stays; a group without any doc_id keeps one row with a null keep_id;
if rows repeat a doc_id within a group one of them stays; texts of any length
are read whole; an empty table gives an empty result; further columns ride
along in ``drop_repeats``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import written

HASHES = 2
_NO_ID = -(1 << 63)
#: Own columns, named so that they clash with none of the caller's.
_KEY, _FLAG, _ROW = "__fl_digest", "__fl_possible", "__fl_row"


def lowered(text: Column) -> Column:
    """Text with A-Z alone lower-cased; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_digest(text: Column) -> Column:
    """SHA-256 of the lower-cased text, in hex."""
    return F.sha2(F.encode(lowered(text), "UTF-8"), 256)


def _positions(digest: Column, bits: int) -> list[Column]:
    """Hash positions: eight hex digits of the digest each, which is uniform."""
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") % bits for k in range(HASHES)]


def _range(digest: Column, ranges: int) -> Column:
    """The range of a digest, from hex digits that no position uses."""
    return F.conv(F.substring(digest, 1 + 8 * HASHES, 8), 16, 10).cast("long") % ranges


def repeated_positions(digests: DataFrame, bits: int) -> DataFrame:
    """``k, bucket, bitmap`` of the positions that two or more rows hit; at most ``bits / 8`` bytes for each k."""
    hits = bloom.positions(digests, _positions(F.col(_KEY), bits))
    return bloom.bitmaps(hits.groupBy("k", "position").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def flag_possible(digests: DataFrame, bits: int | None = None, ranges: int | None = None) -> DataFrame:
    """``digests``, a written table, plus a flag: false only for digests that occur once."""
    rows = digests.count()  # from Parquet footers
    ranges = ranges or max(1, -(-16 * rows // bloom.MAX_BITS))
    bits = bits or bloom.bits_for(-(-rows // ranges))
    out = None
    for r in range(ranges):
        part = digests if ranges == 1 else digests.where(_range(F.col(_KEY), ranges) == r)
        part = bloom.flagged(part, _positions(F.col(_KEY), bits), written(repeated_positions(part, bits), "bloom"), _FLAG)
        part = part if ranges == 1 else written(part, "flagged")  # one range's bitmaps are broadcast at a time
        out = part if out is None else out.unionByName(part)
    return out


def _digested(docs: DataFrame) -> DataFrame:
    """``doc_id``, digest and a number of each row, as a table: only these go on."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias(_KEY))
    return written(rows.withColumn(_ROW, F.monotonically_increasing_id()), "digests")


def _sizes(maybe: DataFrame) -> DataFrame:
    """Digest, the row that stays and the number of rows, as a table of its own, so that its join with a hot group can be split."""
    best = F.max(F.struct("doc_id", _ROW)).alias("best")
    return written(maybe.groupBy(_KEY).agg(best, F.count(F.lit(1)).alias("group_size")), "sizes")


def groups(docs: DataFrame, bits: int | None = None, ranges: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): keep_id, group_size, kept, text_sha256.

    Only rows that the filter calls possibly repeated shuffle, as digests and
    ids. They are summed by digest within tasks first.
    """
    rows = flag_possible(_digested(docs), bits, ranges)
    alone = rows.where(~F.col(_FLAG)).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col(_KEY).alias("text_sha256"))
    maybe = rows.where(F.col(_FLAG)).select("doc_id", _KEY, _ROW)
    copies = maybe.join(_sizes(maybe), _KEY).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col(_ROW) == F.col(f"best.{_ROW}")).alias("kept"), F.col(_KEY).alias("text_sha256")
    )
    return alone.unionByName(copies)


def drop_repeats(docs: DataFrame, bits: int | None = None, ranges: int | None = None) -> DataFrame:
    """``docs`` without rows whose text an equal text with a larger doc_id repeats; all columns stay.

    The rows that stay are chosen among digests and ids; neither they nor the
    rows that leave are moved. Rows that repeat their group's largest doc_id,
    and groups without any, are told apart by whole rows, reduced to one
    within each task first.
    """
    digests = _digested(docs)
    maybe = flag_possible(digests, bits, ranges).where(F.col(_FLAG)).select("doc_id", _KEY, _ROW)
    sizes = _sizes(maybe).where("group_size > 1")
    judged = written(maybe.join(sizes, _KEY).select("doc_id", _KEY, F.col("best.doc_id").alias("keep_id")), "judged")
    twins = judged.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(_KEY, "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = written(twins.select(_KEY, "doc_id"), "twins")
    # rows are named by doc_id (null: the number below all others) and a hash of their digest
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(_KEY).alias("hash")]
    leave = judged.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*own).unionByName(twins.select(*own))
    keys = [own[0], F.xxhash64(text_digest(F.col("text")))]
    out = bloom.without(docs, keys, digests.select(*own), written(leave.distinct(), "leave"))
    if twins.isEmpty():
        return out
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__fl_whole"), *[k.alias(f"__fl_{n}") for n, k in zip(("id", "hash"), keys)])
    same = keyed.join(twins.select(*[c.alias(f"__fl_{n}") for n, c in zip(("id", "hash"), own)]), ["__fl_id", "__fl_hash"], "left_semi")
    best = F.max_by("__fl_whole", F.sha2(F.coalesce(F.col("__fl_whole.text"), F.lit("")), 256)).alias("__fl_whole")
    return out.unionByName(same.groupBy("__fl_id", "__fl_hash").agg(best).select("__fl_whole.*"))
