"""Connected components of a large edge list, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_ROUNDS = 60


def dealt_anew(sums: DataFrame, key: str) -> DataFrame:
    """``sums`` by a 64-bit ``key`` under an expression of equal value, so that a join with the summed rows deals out both sides.

    Sides that keep the dealing of their sums can't be split by the skew join,
    and all rows of a hot key would meet in one task.
    """
    return sums.select(F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key), *[c for c in sums.columns if c != key])


def components(edges: DataFrame) -> DataFrame:
    """``node long, root long``: the smallest node of each component, for all nodes on edges (a, b).

    Alternates the large-star and small-star steps (Kiveris et al., 2014): in
    each, every node hands its neighbours to the smallest node it knows. The
    edge list never grows, a hub's neighbours are never gathered in one row,
    and the number of rounds is logarithmic. Edges go through a table each
    round, which cuts lineage and survives lost executors.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        low = dealt_anew(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "a")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt_anew(low, "a"), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, "edges")
        after = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())
