"""Numbers and units as column expressions.

Every rule is a built-in expression, so parsing stays inside generated code.
Regular expressions are Unicode-aware where the written text may be.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import blank_to_null, compatible, has, is_true, let, null_text, part, trimmed

# The written forms that the unit rules know, in their order.
MAGNITUDES = {
    1e12: ("trillion", "tn", "tr"),
    1e9: ("billion", "bn", "b"),
    1e7: ("crore", "crores", "cr"),
    1e6: ("million", "mn", "mil", "m"),
    1e5: ("lakh", "lakhs", "lac"),
    1e3: ("thousand", "k"),
    1e2: ("hundred",),
}
CURRENCIES = {
    "INR": (("₹", "rs.", "रू"), ("rs", "inr")),
    "USD": (("$",), ("usd",)),
    "EUR": (("€",), ("eur",)),
    "GBP": (("£",), ("gbp",)),
    "JPY": (("¥",), ("jpy",)),
}
CURRENCY_WORDS = ("₹", "rs", "rs.", "inr", "रू", "$", "us$", "usd", "€", "eur", "£", "gbp", "¥", "jpy")
POINT_MARKERS = ("percentage point", "pp", "bps", "basis point")
PERCENT_MARKERS = ("%", "percent", "per cent")
RATIO_WORDS = ("ratio", "times", "x")

_NUMBER = r"(?U)[-+]?\d+(?:,\d{2,3})*(?:\.\d+)?"
_BRACKETED = r"\(\s*(\d[\d,\s]*(?:\.\d+)?)\s*\)"
UNIT_TYPE = "struct<family:string,canonical:string,scale:double,raw:string>"


def clean(text: Column) -> Column:
    """Compatibility form with plain minus signs and no gaps around a decimal point."""
    text = trimmed(F.translate(compatible(text), "−", "-"))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)(?<=\.)\s+(?=\d)", ""), r"(?U)(?<=\d)\s+(?=\.)", "")


def parse_number(value: Column) -> Column:
    """The one number in a written value; null if it has none or several. Brackets negate."""

    def read(text: Column) -> Column:
        boxed = text.startswith("(") & text.endswith(")")
        return let(part(text, _BRACKETED, 0), lambda whole: _signed(_opened(text, whole, boxed), whole.isNotNull() | boxed))

    return let(clean(value), read)


def _opened(text: Column, whole: Column, boxed: Column) -> Column:
    """Text without the brackets of its first bracketed number, or around all of it."""
    at = F.instr(text, whole)
    inside = F.concat(F.substring(text, F.lit(1), at - 1), part(whole, _BRACKETED), F.substring(text, at + F.length(whole), F.length(text)))
    return F.when(whole.isNotNull(), inside).when(boxed, trimmed(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)


def _signed(text: Column, negative: Column) -> Column:
    """The only number in a text, or null."""

    def one(found: Column) -> Column:
        number = F.replace(F.get(found, F.lit(0)), F.lit(",")).try_cast("double")
        return F.when(F.size(found) == 1, F.when(negative, -number).otherwise(number))

    return let(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), one)


def decimals_of(value: Column) -> Column:
    """Digits after the first decimal point; 0 without one, null for no text."""
    return F.when(F.nullif(value, F.lit("")).isNotNull(), F.coalesce(F.length(part(value, r"\.(\d+)")), F.lit(0)))


def _contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | text.contains(marker)
    return is_true(found)


def magnitude(text: Column) -> Column:
    """Scale of the largest magnitude word that stands alone in lower-case text, else 1."""
    scale = F.lit(1.0)
    for factor, words in reversed(MAGNITUDES.items()):
        alone = text.rlike(rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])")
        scale = F.when(alone, F.lit(factor)).otherwise(scale)
    return scale


def currency(text: Column) -> Column:
    """Code of the first currency in the fixed order that lower-case text names, else null."""
    code = null_text()
    for name, (signs, words) in reversed(CURRENCIES.items()):
        named = _contains_any(text, signs) | is_true(text.rlike(rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"))
        code = F.when(named, name).otherwise(code)
    return code


def bare_unit(text: Column) -> Column:
    """Lower-case text without numbers, currencies, magnitudes and stray signs."""
    words = F.split(F.regexp_replace(text, _NUMBER, " "), r"(?U)[\s/,()\[\]]+")
    known = [*CURRENCY_WORDS, *(w for ws in MAGNITUDES.values() for w in ws)]
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(known) & ~w.rlike(r"^[₹$€£¥.\-]+$"))
    return F.array_join(kept, " ")


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by underscores; 'unit' if none are left."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("unit"))


def parse_unit(unit: Column, value: Column) -> Column:
    """``struct<family, canonical, scale, raw>`` from both written texts, or null if nothing resolves."""
    unit, value = F.nullif(unit, F.lit("")), F.nullif(value, F.lit(""))
    inputs = F.struct(F.lower(clean(F.concat_ws(" ", unit, value))).alias("text"), clean(unit).alias("raw"))
    return let(inputs, lambda x: _resolved(x["text"], x["raw"]))


def _resolved(text: Column, raw: Column) -> Column:
    def made(family: str, canonical: Column, factor: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), canonical.alias("canonical"), factor.alias("scale"), raw.alias("raw"))

    def other(rest: Column) -> Column:
        return (
            F.when(rest.isin(*RATIO_WORDS), made("ratio", F.lit("ratio"), F.lit(1.0)))
            .when(rest != "", made("other", slug(rest), magnitude(text)))
            .otherwise(F.lit(None).cast(UNIT_TYPE))
        )

    def plain(code: Column) -> Column:
        return F.when(code.isNotNull(), made("currency", code, magnitude(text))).otherwise(let(bare_unit(text), other))

    small = F.when(_contains_any(text, ("bps", "basis point")), 0.01).otherwise(1.0)
    return (
        F.when(_contains_any(text, POINT_MARKERS), made("percentage_point", F.lit("percentage_point"), small))
        .when(_contains_any(text, PERCENT_MARKERS), made("percent", F.lit("percent"), F.lit(1.0)))
        .otherwise(let(currency(text), plain))
    )


def to_base(value: Column, unit: Column) -> Column:
    """The written number in its unit's base; null without number or unit."""
    return parse_number(value) * unit["scale"]


def relative_gap(a: Column, b: Column) -> Column:
    """Difference in proportion to the larger magnitude; 0 if both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 0.0).otherwise(F.abs(a - b) / top)


#: Relative tolerance, and the flat one of percentages.
RELATIVE_TOLERANCE, POINT_TOLERANCE = 0.005, 0.1


def values_agree(a: Column, b: Column, family: Column, decimals: Column) -> Column:
    """Whether two values of one context agree, by their family's tolerance. Never null."""
    apart = F.abs(a - b)
    flat = is_true(family.isin("percent", "percentage_point"))
    last = F.coalesce(F.pow(F.lit(10.0), -decimals.cast("double")), F.lit(0.0))
    band = F.greatest(RELATIVE_TOLERANCE * F.greatest(F.abs(a), F.abs(b)), last)
    return is_true(apart <= F.when(flat, POINT_TOLERANCE).otherwise(band) + 1e-12)


def written_unit(unit: Column) -> Column:
    """Unit text that says something, else null."""
    return blank_to_null(unit)


def numeric_claim(unit: Column) -> Column:
    return written_unit(unit).isNotNull()


def has_digit(value: Column) -> Column:
    return has(value, r"\d")
