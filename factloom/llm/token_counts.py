"""Operator 3: exact length histogram with suffix sums.

Documents are counted by encoded length; tasks pre-aggregate, so only
(length, count) pairs shuffle. Suffix sums over the distinct lengths then
answer totals, quantiles and truncated totals for every context limit, with
no further pass over the documents.

Defined results: null and empty texts have length 0 plus the end id if one is
set; texts of any length are read whole; repeated rows each count; an empty table gives an empty histogram;
further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

#: Lengths that share a block of the two-level suffix sum.
BLOCK = 64


def _counter(tokenizer: str, end_tokens: int):
    """Reads batches of texts; yields one (length, count) batch. Lean, since two workers and a full heap share an executor's memory."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(tokenizer, lean=True), Counter()
        for batch in batches:
            for _, offsets in enc.encode_column(batch.column(0), counts_only=True):
                lengths.update((np.diff(offsets) + end_tokens).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(lengths), pa.int64()), pa.array(list(lengths.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return count


def length_histogram(docs: DataFrame, tokenizer: str, end_tokens: int = 1) -> DataFrame:
    """``n_tokens long, n_docs long``: how many documents have each encoded length."""
    counted = docs.select("text").mapInArrow(_counter(tokenizer, end_tokens), "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per distinct length L, with sums over the documents of length L or more.

    Adds docs_from, tokens_from, docs_total, tokens_total, truncated_total (all
    tokens kept when every document is cut to L) and rank_from (documents
    shorter than L). Two-level: blocks of ``BLOCK`` lengths are summed first
    and only block totals, one per ``BLOCK`` lengths, meet in one window.
    """
    h = written(histogram, "histogram").withColumn("block", (F.col("n_tokens") / BLOCK).cast("long")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("docs_total"),
        F.sum("t").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_after")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("tokens_after")).alias("tokens_from"),
        "docs_total",
        "tokens_total",
    )
    cut = F.col("tokens_total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    return out.select("*", cut.alias("truncated_total"), (F.col("docs_total") - F.col("docs_from")).alias("rank_from"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, kept_tokens, cut_docs``: exact for any limits, present as lengths or not, read off the suffix sums."""
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "n_tokens long")
    asked = histogram.select("n_tokens", "n_docs").unionByName(wanted.withColumn("n_docs", F.lit(0).cast("long"))).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    found = suffix_sums(asked).join(F.broadcast(wanted), "n_tokens")  # the limits of one call
    return found.select(F.col("n_tokens").alias("context_limit"), F.col("truncated_total").alias("kept_tokens"), (F.col("docs_from") - F.col("n_docs")).alias("cut_docs"))


def quantile(suffixes: DataFrame, share: float | str | Fraction) -> DataFrame:
    """One row: the smallest length that at least ``share`` of the documents do not exceed; null without documents.

    The share counts as the decimal number that it is written as, in whole
    numbers throughout, so no rounding shifts the rank.
    """
    part = Fraction(str(share))
    upto, total = ((F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)") for c in (F.col("rank_from") + F.col("n_docs"), "docs_total"))
    enough = upto * F.lit(part.denominator).cast("decimal(19,0)") >= total * F.lit(part.numerator).cast("decimal(19,0)")
    return suffixes.where(enough).where("n_docs > 0").agg(F.min("n_tokens").alias("n_tokens"))
