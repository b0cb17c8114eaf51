"""Finding quotes in pages: verbatim, normalized, then fuzzy, each only where the better way failed.

The page that a quote was read from is tried in all ways first, then the other
pages of its document. The exact tiers are JVM expressions over equi-joins;
only quotes that neither finds reach the fuzzy Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import collapsed, in_slices, is_true
from ..session import written

MIN_SCORE = 0.85
# Trust in a way of finding a quote.
METHOD_RANK = {"search_for": 3, "normalized": 2, "fuzzy": 1}
# Code points that never decide whether a quote matches, by what they fold to.
FOLDS = {
    "'": (0x2018, 0x2019, 0x201A, 0x201B, 0x2032),
    '"': (0x201C, 0x201D, 0x201E),
    "-": (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212),
    " ": (0x00A0, 0x2005, 0x2006, 0x2007, 0x2009, 0x200A, 0x202F),
    "": (0x00AD, 0x200B, 0x200C, 0x200D, 0xFEFF),
}
_TABLE = {code: plain for plain, codes in FOLDS.items() for code in codes}


def fold(text: str | None) -> str:
    """Compatibility form, folded signs, case-folded, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text or "").translate(_TABLE).casefold().split())


@F.arrow_udf(T.StringType())
def normalize_text(text: pa.Array) -> pa.Array:
    return in_slices(text, pa.string(), lambda values: list(map(fold, values)))


def is_verbatim(span: Column, page: Column, exact: bool = True) -> Column:
    """Whether a page says a quote; without ``exact`` white space doesn't count."""
    stated = (F.coalesce(F.length(span), F.lit(0)) > 0) & (F.coalesce(F.length(page), F.lit(0)) > 0)
    found = F.contains(page, span) if exact else F.contains(page, span) | F.contains(collapsed(page), collapsed(span))
    return stated & is_true(found)


def _run(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many signs from two places on are equal, ``most`` at most."""
    size, step = 0, 64
    while step:
        if size + step <= most and a[i + size : i + size + step] == b[j + size : j + size + step]:
            size += step
        else:
            step //= 2
    return size


def matched_signs(a: str, b: str) -> int:
    """Signs in the matching blocks of two texts, as ``difflib.SequenceMatcher`` finds them without junk.

    The longest common run, the first in ``a`` and then in ``b`` of equals, and
    so on to its left and right. Runs are sought by ``str.find`` for one sign
    more than the longest so far, not sign by sign.
    """
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        i, a_end, b_start, b_end = todo.pop()
        start, place, best, a_start = 0, 0, 0, i
        while i + best < a_end:
            found = b.find(a[i : i + best + 1], b_start, b_end)
            while found >= 0:
                size = best + 1
                start, place, best = i, found, size + _run(a, i + size, b, found + size, min(a_end - i, b_end - found) - size)
                found = b.find(a[i : i + best + 1], b_start, b_end) if i + best < a_end else -1
            i += 1
        if best:
            total += best
            if a_start < start and b_start < place:
                todo.append((a_start, start, b_start, place))
            if start + best < a_end and place + best < b_end:
                todo.append((start + best, a_end, place + best, b_end))
    return total


def _sign_counts(tokens: list[str], signs: np.ndarray) -> np.ndarray:
    """How often each token has each of some signs, which are sorted."""
    text = np.array(list("".join(tokens)))
    at = np.minimum(np.searchsorted(signs, text), len(signs) - 1)
    owner = np.repeat(np.arange(len(tokens)), [len(token) for token in tokens])
    known = signs[at] == text
    return np.bincount(owner[known] * len(signs) + at[known], minlength=len(tokens) * len(signs)).reshape(len(tokens), len(signs))


def fuzzy_window(quote: str, page: str, min_score: float = MIN_SCORE) -> tuple[float, str] | None:
    """Score and text of the run of words most like a quote, two words longer or shorter at most.

    The signs that a run shares with the quote bound its score. They are counted
    for all runs at once by running sums, and runs are scored from the greatest
    bound down to the best score so far. The first of equal scores counts, by
    number of words, then by place.
    """
    needle, words = fold(quote), (page or "").split()
    tokens = page.lower().split() if page and page.isascii() else [fold(word) for word in words]
    words, tokens = [w for w, t in zip(words, tokens) if t], [t for t in tokens if t]
    if not needle or not tokens:
        return None
    wanted = needle.count(" ") + 1
    signs, have = np.unique(list(needle), return_counts=True)
    sums = np.zeros((len(tokens) + 1, len(signs)), np.int64)
    sums[1:] = np.cumsum(_sign_counts(tokens, signs), axis=0)
    ends = np.concatenate(([0], np.cumsum([len(token) for token in tokens])))
    widths = [w for w in range(max(1, wanted - 2), wanted + 3) if w <= len(tokens)] or [len(tokens)]
    runs = []
    for width in widths:
        counts = sums[width:] - sums[:-width] + (width - 1) * (signs == " ")
        size = ends[width:] - ends[:-width] + width - 1
        bound = 2 * np.minimum(counts, have).sum(1) / (size + len(needle))
        runs += [(-bound[at], width, at) for at in np.flatnonzero(bound >= min_score).tolist()]
    best = None
    for bound, width, at in sorted(runs):
        if best and -bound < -best[0]:
            break
        run = " ".join(tokens[at : at + width])
        score = 2.0 * matched_signs(run, needle) / (len(run) + len(needle))
        if score >= min_score and (best is None or (-score, width, at) < best):
            best = -score, width, at
    return best and (-best[0], " ".join(words[best[2] : best[2] + best[1]]))


def _fuzzy(min_score: float):
    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("matched_text", T.StringType())]))
    def find(quote: pd.Series, page: pd.Series) -> pd.DataFrame:
        hits = [fuzzy_window(q, p, min_score) if q and p else None for q, p in zip(quote, page)]
        return pd.DataFrame([h or (None, None) for h in hits], columns=["score", "matched_text"])

    return find


def _best(found: DataFrame) -> DataFrame:
    """The most trusted location of each quote: method, then score, then the earlier page."""
    rank = F.when(F.col("grounding_method") == "search_for", 3).when(F.col("grounding_method") == "normalized", 2).otherwise(1)
    keyed = F.struct(rank.alias("rank"), F.col("score"), -F.col("page_index"))
    row = F.struct("page_index", "grounding_method", "score", "matched_text")
    return found.groupBy("doc_id", "quote", "origin").agg(F.max_by(row, keyed).alias("best")).select("doc_id", "quote", F.col("origin").alias("__origin"), "best.*")


def ground_quotes(quotes: DataFrame, pages: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``quotes`` (doc_id, quote, page_index or null) with their best location in ``pages`` (doc_id, page_index, text).

    A quote is sought in all three ways on the page it was read from, and in
    the whole document only if it isn't there. Quotes that are nowhere come out
    with nulls.
    """
    asked = quotes.select("doc_id", "quote", F.col("page_index").alias("origin")).where(F.trim(F.coalesce("quote", F.lit(""))) != "").distinct()
    near = written(asked.withColumn("needle", normalize_text("quote")), "quotes")
    folded = written(pages.select("doc_id", "page_index", "text", normalize_text("text").alias("folded")), "folded")
    home = near.join(folded, (near["doc_id"] == folded["doc_id"]) & (near["origin"] == folded["page_index"])).drop(folded["doc_id"])
    found = written(_located(home, min_score), "at_home")
    same = near["doc_id"].eqNullSafe(found["doc_id"]) & near["quote"].eqNullSafe(found["quote"]) & near["origin"].eqNullSafe(found["origin"])
    away = near.join(found, same, "left_anti")
    found = found.unionByName(_located(away.join(folded, "doc_id"), min_score))
    best = _best(found).select(F.col("doc_id").alias("__d"), F.col("quote").alias("__q"), "__origin", F.col("page_index").alias("found_on"), "grounding_method", "score", "matched_text")
    own = quotes.select("*", F.col("page_index").alias("__at"))
    same = (F.col("doc_id") == F.col("__d")) & (F.col("quote") == F.col("__q")) & F.col("__at").eqNullSafe(F.col("__origin"))
    return own.join(best, same, "left").drop("__d", "__q", "__origin", "__at")


def _located(tried: DataFrame, min_score: float) -> DataFrame:
    """Locations of quotes on the pages they are paired with; fuzzy ones only of quotes that no page of theirs has exactly."""
    tried = written(tried.select("doc_id", "quote", "origin", "needle", "page_index", "text", "folded"), "tried")
    exact = F.when(is_verbatim(F.col("quote"), F.col("text")), "search_for").when((F.col("needle") != "") & F.contains("folded", "needle"), "normalized")
    hits = tried.withColumn("grounding_method", exact).where("grounding_method is not null")
    hits = written(hits.select("doc_id", "quote", "origin", "page_index", "grounding_method", F.lit(1.0).alias("score"), F.col("quote").alias("matched_text")), "hits")
    known = hits.select(F.col("doc_id").alias("d"), F.col("quote").alias("q"), F.col("origin").alias("o")).distinct()
    left = tried.join(known, (F.col("doc_id") == F.col("d")) & (F.col("quote") == F.col("q")) & F.col("origin").eqNullSafe(F.col("o")), "left_anti")
    left = left.withColumn("hit", _fuzzy(min_score)("quote", "text"))
    fuzzy = left.where("hit.matched_text is not null").select("doc_id", "quote", "origin", "page_index", F.lit("fuzzy").alias("grounding_method"), "hit.score", "hit.matched_text")
    return hits.unionByName(fuzzy)


def line_rects(words: DataFrame, keys: list[str]) -> DataFrame:
    """One box for each text line of the matched words (keys, block, line, position, x0, y0, x1, y1), in reading order."""
    boxes = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return words.groupBy(*keys, "block", "line").agg(*boxes, F.min("position").alias("position"))


def union_box(rects: DataFrame, keys: list[str]) -> DataFrame:
    return rects.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def merge_visual_lines(rects: Column) -> Column:
    """An array of boxes folded into one box a visual line.

    Boxes are taken from top to bottom and left to right; each joins the first
    line whose box so far spans the box's vertical centre.
    """
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    ordered = F.array_sort(F.transform(rects, lambda r: F.struct(F.round(r["y0"], 1).alias("k"), r["x0"].alias("x"), r.cast(box).alias("r"))))

    def add(lines: Column, item: Column) -> Column:
        r = item["r"]
        centre = (r["y0"] + r["y1"]) / 2
        indexed = F.transform(lines, lambda l, i: F.when((l["y0"] <= centre) & (centre <= l["y1"]), i))
        at = F.array_min(indexed)
        merged = F.transform(
            lines,
            lambda l, i: F.when(
                i == at, F.struct(F.least(l["x0"], r["x0"]).alias("x0"), F.least(l["y0"], r["y0"]).alias("y0"), F.greatest(l["x1"], r["x1"]).alias("x1"), F.greatest(l["y1"], r["y1"]).alias("y1"))
            ).otherwise(l),
        )
        return F.when(at.isNull(), F.concat(lines, F.array(r))).otherwise(merged)

    return F.aggregate(ordered, F.array().cast(f"array<{box}>"), add)


def highlight_box(rect: Column, pad: float, zoom: float) -> Column:
    """Pixel box of a padded highlight on a page drawn at ``zoom``."""
    return F.struct(
        ((rect["x0"] - pad) * zoom).alias("x0"), ((rect["y0"] - pad) * zoom).alias("y0"), ((rect["x1"] + pad) * zoom).alias("x1"), ((rect["y1"] + pad) * zoom).alias("y1")
    )
