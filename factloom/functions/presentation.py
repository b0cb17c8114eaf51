"""Facts as readers see them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels of unit words, and the spellings with which a value already says them.
CURRENCIES = {
    "INR": ("₹", ("₹", "inr", "rs", "rs.", "rupee", "rupees")),
    "USD": ("US$", ("$", "usd", "us$", "dollar", "dollars")),
    "EUR": ("€", ("€", "eur", "euro", "euros")),
}
SUFFIXES = {
    "million": ("million", ("million", "mn", "mm")),
    "billion": ("billion", ("billion", "bn")),
    "trillion": ("trillion", ("trillion", "tn")),
    "thousand": ("thousand", ("thousand", "k")),
    "crore": ("crore", ("crore", "crores", "cr")),
    "lakh": ("lakh", ("lakh", "lakhs", "lac")),
    "percent": ("%", ("%", "percent", "per cent", "pc")),
    "percentage": ("percentage point", ("percentage point", "pp")),
    "point": ("point", ("point", "points")),
    "bps": ("bps", ("bps", "basis point", "basis points")),
    "years": ("years", ("year", "years", "yr", "yrs")),
    "months": ("months", ("month", "months")),
    "days": ("days", ("day", "days")),
    "tons": ("tons", ("ton", "tons", "tonne", "tonnes")),
    "tonnes": ("tonnes", ("tonne", "tonnes", "ton", "tons")),
    "MT": ("MT", ("mt", "metric ton", "metric tonnes")),
    "GW": ("GW", ("gw", "gigawatt", "gigawatts")),
    "MW": ("MW", ("mw", "megawatt", "megawatts")),
    "kg": ("kg", ("kg", "kilogram", "kilograms")),
    "count": ("", ()),
    "per": ("per", ("per", "/")),
}
# Label, tone and sign of each verdict, in the order of display.
VERDICTS = {
    "contradict": ("Contradiction", "contradict", "≠"),
    "corroborate": ("Corroborated", "corroborate", "="),
    "reconcilable": ("Reconciled", "reconcile", "≈"),
    "no-verdict": ("No verdict", "neutral", "·"),
}


def _says(value: str, spelling: str) -> bool:
    if re.fullmatch(r"[a-z0-9. ]+", spelling):
        return re.search(rf"(?:^|[^a-z]){re.escape(spelling)}(?:[^a-z]|$)", value, re.I) is not None
    return spelling in value.lower()


def shown_value(value: str | None, unit: str | None, comparable: bool) -> str:
    """A value on one line with the unit words that it doesn't say itself; a dash for none."""
    written = " ".join((value or "").split())
    if not written or not comparable or not unit:
        return written or "—"
    front, tail = "", ""
    for word in filter(None, unit.split("_")):
        sign, spellings = CURRENCIES.get(word.upper(), (None, ()))
        if sign is not None:
            front = front if any(_says(written, s) for s in spellings) else sign
            continue
        label, spellings = SUFFIXES.get(word) or SUFFIXES.get(word.lower()) or (word, (word.lower(),))
        if label and not any(_says(written, s) for s in spellings):
            tail += label if label == "%" else f" {label}"
    return front + written + tail


@F.pandas_udf(T.StringType())
def format_value(value: pd.Series, unit: pd.Series, comparable: pd.Series) -> pd.Series:
    return pd.Series([shown_value(v, u, bool(c)) for v, u, c in zip(value, unit, comparable)], dtype="object")


def _sentence(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def format_attribute(attribute: Column) -> Column:
    words = _sentence(F.trim(F.regexp_replace(attribute, "[_-]+", " ")))
    return F.when(F.coalesce(attribute, F.lit("")) == "", "—").otherwise(words)


def format_document(name: Column) -> Column:
    words = _sentence(F.trim(F.regexp_replace(F.regexp_replace(name, r"^\d+[-_]", ""), "[-_]+", " ")))
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown document").otherwise(words)


def format_period(written: Column, period: Column) -> Column:
    """As written, else the resolved text, else put together from year and part."""
    kind = F.when(period["period_type"] == "FY", "FY").otherwise("")
    built = F.concat(kind, period["fiscal_year"].cast("string"), F.coalesce(F.concat(F.lit(" "), period["sub_period"]), F.lit("")))
    return F.coalesce(F.nullif(written, F.lit("")), F.nullif(period["raw"], F.lit("")), built, F.lit("—"))


def format_page(label: Column, page: Column) -> Column:
    at = F.coalesce(F.nullif(label, F.lit("")), page.cast("string"))
    return F.coalesce(F.concat(F.lit("p. "), at), F.lit(""))


def verdict_label(verdict: Column) -> Column:
    """``struct<label, tone, operator>``."""
    out = F.struct(format_attribute(verdict).alias("label"), F.lit("neutral").alias("tone"), F.lit("·").alias("operator"))
    for name, (label, tone, sign) in VERDICTS.items():
        out = F.when(verdict == name, F.struct(F.lit(label).alias("label"), F.lit(tone).alias("tone"), F.lit(sign).alias("operator"))).otherwise(out)
    return out


def verdict_rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)


def plural(count: Column, noun: str, suffix: str = "s") -> Column:
    return F.concat(F.format_number(count, 0), F.lit(f" {noun}"), F.when(count == 1, "").otherwise(suffix))


def text_filter(needle: str) -> Column:
    """Whether a fact's subject, attribute, period and document together contain a text, blind to case."""
    shown = F.concat_ws(" ", F.coalesce("subject", F.lit("")), format_attribute(F.col("attribute")), F.coalesce("context_period", F.lit("")), F.coalesce("source_doc", F.lit("")))
    return F.lower(shown).contains(needle.strip().lower())


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text

