"""Scope, vintage and measurement basis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import blank_to_null, has, is_true, let, null_text
from .periods import is_resolved, parse_period, same_period

# Words without meaning of their own in a context token.
FILLERS = ("the", "a", "an", "of", "for", "in", "on", "at", "to", "as", "per", "and")
# Patterns of how settled a figure is, the first that fits wins.
VINTAGES = (
    ("advance_estimate", r"advance\s+estimate|first\s+advance|\bfae\b|\bae\b"),
    ("provisional", r"provisional|\bpe\b"),
    ("revised", r"revised|\bre\b|\bsre\b"),
    ("projection", r"projection|projected|forecast|expected|outlook|\bproj\b"),
    ("final", r"final|actual|audited"),
)
VINTAGE_RANKS = {"advance_estimate": 0, "provisional": 1, "revised": 2, "final": 3}
# Axes of a basis, their values and patterns, the first that fits an axis wins.
FACETS = {
    "price_basis": (("real", r"\bconstant ?price|\binflation ?adjusted\b|\breal\b"), ("nominal", r"\bcurrent ?price|\bnominal\b")),
    "aggregate": (
        ("gva", r"\bgva\b|\bgross ?value ?added\b"),
        ("gdp_factor_cost", r"\bfactor ?cost\b"),
        ("gdp_market_price", r"\bmarket ?price"),
        ("gni", r"\bgni\b|\bgross ?national ?income\b"),
        ("gdp", r"\bgdp\b"),
    ),
    "adjustment": (("seasonally_adjusted", r"\bseasonally ?adjusted\b"),),
}
CONTEXT_FIELDS = ("period", "scope", "basis", "vintage")


def canonical_token(text: Column) -> Column:
    """Words of a context text joined by underscores, without fillers unless nothing else is left; else null."""
    words = F.filter(F.split(F.lower(blank_to_null(text)), r"[^a-z0-9%]+"), lambda w: w != "")

    def joined(all_words: Column) -> Column:
        kept = F.filter(all_words, lambda w: ~w.isin(*FILLERS))
        return F.nullif(F.array_join(F.when(F.size(kept) > 0, kept).otherwise(all_words), "_"), F.lit(""))

    return let(words, joined)


def normalize_scope(text: Column) -> Column:
    low = F.lower(blank_to_null(text))
    return F.when(has(low, "standalone|stand-alone|unconsolidated|non-consolidated"), "standalone").when(has(low, "consolidat"), "consolidated").otherwise(canonical_token(text))


def normalize_vintage(text: Column) -> Column:
    low, found = F.lower(blank_to_null(text)), canonical_token(text)
    for name, pattern in reversed(VINTAGES):
        found = F.when(has(low, pattern), name).otherwise(found)
    return found


def normalize_basis(text: Column) -> Column:
    return canonical_token(text)


def vintage_rank(vintage: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in VINTAGE_RANKS.items() for x in pair]), vintage)


def newer_vintage(a: Column, b: Column) -> Column:
    """The vintage that supersedes the other; null if either has no rank or both have the same."""
    left, right = vintage_rank(a), vintage_rank(b)
    return F.when(left > right, a).when(right > left, b)


def facets(basis: Column) -> Column:
    """``struct<price_basis, aggregate, adjustment>``: what a basis pins down on each axis."""

    def axes(text: Column) -> Column:
        found = []
        for axis, values in FACETS.items():
            value = null_text()
            for name, pattern in reversed(values):
                value = F.when(has(text, pattern), name).otherwise(value)
            found.append(value.alias(axis))
        return F.struct(*found)

    return let(F.regexp_replace(F.lower(blank_to_null(basis)), r"[_\-]+|(?U)\s", " "), axes)


def basis_conflict(a: Column, b: Column) -> Column:
    """Whether two bases differ on an axis that both name; unknown wording differs from all else."""

    def known(f: Column) -> Column:
        return F.coalesce(*[f[axis] for axis in FACETS]).isNotNull()

    def differ(f: Column) -> Column:
        apart = F.lit(False)
        for axis in FACETS:
            apart = apart | is_true(f["a"][axis] != f["b"][axis])
        return ~known(f["a"]) | ~known(f["b"]) | apart

    read = let(F.struct(facets(a).alias("a"), facets(b).alias("b")), differ)
    return F.when(a.eqNullSafe(b), False).when(a.isNull() | b.isNull(), True).otherwise(read)


def build_signature(period: Column, scope: Column, basis: Column, vintage: Column) -> Column:
    return F.struct(parse_period(period).alias("period"), normalize_scope(scope).alias("scope"), normalize_basis(basis).alias("basis"), normalize_vintage(vintage).alias("vintage"))


def _named(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(flag, name) for name, flag in flags.items()]))


def differing_fields(a: Column, b: Column) -> Column:
    """Names of the context fields that both signatures state differently, most important first."""
    flags = {"period": is_resolved(a["period"]) & is_resolved(b["period"]) & ~same_period(a["period"], b["period"])}
    flags |= {f: is_true(a[f] != b[f]) for f in CONTEXT_FIELDS[1:-1] if f != "basis"}
    flags["basis"] = is_true(a["basis"].isNotNull() & b["basis"].isNotNull() & basis_conflict(a["basis"], b["basis"]))
    flags["vintage"] = is_true(a["vintage"] != b["vintage"])
    return _named(flags)


def unstated_fields(a: Column, b: Column) -> Column:
    """Names of the context fields that just one signature states."""
    flags = {"period": is_resolved(a["period"]) != is_resolved(b["period"])}
    flags |= {f: a[f].isNull() != b[f].isNull() for f in CONTEXT_FIELDS[1:]}
    return _named(flags)
