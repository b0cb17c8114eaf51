"""Written periods as ``struct<period_type, fiscal_year, sub_period, raw>`` column expressions.

A fiscal year runs from April to March and bears the year it ends in. Months
of a period are counted from April (1) to March (12).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import blank_to_null, has, is_true, let, null_text, part

PERIOD_TYPE = "struct<period_type:string,fiscal_year:int,sub_period:string,raw:string>"
# Month names by number.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
#: Month and year written together; forms with a day come first, lest the day be read as a year.
_DATED = (rf"\b({_NAMES})\w*\.?\s+{_DAY}\s*,?\s*(\d{{4}})\b", rf"\b{_DAY}\s+({_NAMES})\w*\.?\s*,?\s*(\d{{4}})\b", rf"\b({_NAMES})\w*\.?\s*[-,]?\s*(\d{{4}}|\d{{2}})\b")
_RANGE = r"(\d{4})\s*[-/–—]\s*(\d{2}|\d{4})\b"
_SINGLE = r"(?:fy|f\.y\.?)\s*[-']?\s*(\d{4}|\d{2})\b"


def expand_year(token: Column, century: Column | None = None) -> Column:
    """Four digits as they are; two digits in the century given, else from 2000; others null."""
    number = token.try_cast("int")
    base = F.lit(2000) if century is None else F.coalesce(F.floor(century / 100).cast("int") * 100, F.lit(2000))
    return F.when(F.length(token) == 4, number).when(F.length(token) == 2, base + number)


def fiscal_year_of(year: Column, month: Column) -> Column:
    return F.when(month >= 4, year + 1).otherwise(year)


def fiscal_quarter_of(month: Column) -> Column:
    return F.floor(F.pmod(month - 4, F.lit(12)) / 3).cast("int") + 1


def _fiscal(text: Column) -> Column:
    """Year that a fiscal notation names: a range of one year, or FY with a year."""
    start = part(text, _RANGE).try_cast("int")

    def within(r: Column) -> Column:
        end = expand_year(r["end"], r["start"])
        return F.when((end - r["start"] > 0) & (end - r["start"] <= 1), end)

    ranged = let(F.struct(start.alias("start"), part(text, _RANGE, 2).alias("end")), within)
    return F.coalesce(ranged, expand_year(part(text, _SINGLE)))


def _sub(text: Column) -> Column:
    """Q1 to Q4, H1 or H2 if the text marks one."""
    halves = F.when(text.contains("first half"), "H1").when(text.contains("second half"), "H2")
    return F.coalesce(F.concat(F.lit("Q"), part(text, r"\bq\s*([1-4])\b")), F.concat(F.lit("H"), part(text, r"\bh\s*([12])\b")), halves)


def _keyword(text: Column) -> Column:
    """The kind of period that a closing date ends."""
    closes = has(text, r"\b(?:ended|ending|end\s+of|closed)\b")
    kind = F.when(has(text, r"\bquarter\b"), "Q").when(has(text, r"\bhalf\b"), "H").when(has(text, r"\byear\b"), "FY").when(has(text, r"\bmonth\b"), "month")
    return F.when(has(text, r"\bas\s+(?:at|of|on)\b|\boutstanding\s+at\b"), "point_in_time").when(closes, kind)


def parse_period(text: Column) -> Column:
    """The period struct of a written period; what doesn't resolve keeps only its text."""

    def read(raw: Column) -> Column:
        low = F.lower(raw)
        return let(F.struct(low.alias("low"), _fiscal(low).alias("fiscal"), _sub(low).alias("sub")), lambda x: _fiscal_first(raw, x))

    return let(blank_to_null(text), read)


def _made(raw: Column, kind: Column | str, fiscal_year: Column, sub_period: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("period_type"), fiscal_year.cast("int").alias("fiscal_year"), (null_text() if sub_period is None else sub_period).alias("sub_period"), raw.alias("raw"))


def _fiscal_first(raw: Column, x: Column) -> Column:
    """The fiscal notation, if there is one; only other texts are read by the further rules."""
    fiscal, sub = x["fiscal"], x["sub"]
    return (
        F.when(fiscal.isNotNull() & sub.isNotNull(), _made(raw, F.substring(sub, 1, 1), fiscal, sub))
        .when(fiscal.isNotNull(), _made(raw, "FY", fiscal))
        .otherwise(let(_readings(x["low"]), lambda r: _resolved(raw, sub, r)))
    )


def _readings(low: Column) -> Column:
    """What a lower-case text without a fiscal year says of a period, rule by rule."""
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    year = F.coalesce(*[F.when(part(low, p, 1).isNotNull(), expand_year(part(low, p, 2))) for p in _DATED])
    return F.struct(
        _keyword(low).alias("keyword"),
        F.try_element_at(names, F.coalesce(*[part(low, p, 1) for p in _DATED])).alias("month"),
        year.alias("year"),
        part(low, r"\b(\d{4})\b").try_cast("int").alias("bare"),
        part(low, r"(?:cy|calendar\s+year)\s*(\d{4})\b").try_cast("int").alias("calendar"),
        part(low, r"^\D*(\d{4})\D*$").try_cast("int").alias("lone"),
    )


def _resolved(raw: Column, sub: Column, r: Column) -> Column:
    """The first reading that makes a period."""
    keyword, month = r["keyword"], r["month"]
    kind, fiscal, quarter = F.substring(sub, 1, 1), fiscal_year_of(r["year"], month), fiscal_quarter_of(month)

    def made(kind: Column | str, fiscal_year: Column, sub_period: Column | None = None) -> Column:
        return _made(raw, kind, fiscal_year, sub_period)

    dated = (
        F.when(is_true(keyword == "FY"), made("FY", fiscal))
        .when(is_true(keyword == "Q") | is_true(kind == "Q"), made("Q", fiscal, F.coalesce(sub, F.concat(F.lit("Q"), quarter.cast("string")))))
        .when(is_true(keyword == "H") | is_true(kind == "H"), made("H", fiscal, F.coalesce(sub, F.when(quarter <= 2, "H1").otherwise("H2"))))
        .otherwise(made(F.when(is_true(keyword == "point_in_time"), "point_in_time").otherwise("month"), fiscal, F.concat(F.lit("M"), F.lpad(month.cast("string"), 2, "0"))))
    )
    return (
        F.when(month.isNotNull() & r["year"].isNotNull(), dated)
        .when(sub.isNotNull() & r["bare"].isNotNull(), made(kind, r["bare"], sub))
        .when(r["calendar"].isNotNull(), made("CY", r["calendar"]))
        .when(r["lone"].between(1900, 2200), made("CY", r["lone"]))
        .otherwise(made(null_text(), F.lit(None)))
    )


def is_resolved(period: Column) -> Column:
    return is_true(period["period_type"].isNotNull() & period["fiscal_year"].isNotNull())


def span(period: Column) -> tuple[Column, Column]:
    """First and last month of a fiscal period, both null for calendar years and unresolved ones."""
    kind, number = period["period_type"], F.substring(period["sub_period"], 2, 2).try_cast("int")
    month = F.when(number >= 4, number - 3).otherwise(number + 9)
    low = F.when(kind == "FY", 1).when(kind == "Q", 3 * number - 2).when(kind == "H", 6 * number - 5).when(kind.isin("month", "point_in_time"), month)
    high = F.when(kind == "FY", 12).when(kind == "Q", 3 * number).when(kind == "H", 6 * number).when(kind.isin("month", "point_in_time"), month)
    return F.when(period["fiscal_year"].isNotNull(), low), F.when(period["fiscal_year"].isNotNull(), high)


def contains(a: Column, b: Column) -> Column:
    """Whether a fiscal period holds a different one entirely; calendar years only hold their like."""
    (a_low, a_high), (b_low, b_high) = span(a), span(b)
    calendar = (a["period_type"] == "CY") | (b["period_type"] == "CY")
    inside = (a["fiscal_year"] == b["fiscal_year"]) & ((a_low != b_low) | (a_high != b_high)) & (a_low <= b_low) & (b_high <= a_high)
    same = (a["period_type"] == b["period_type"]) & (a["fiscal_year"] == b["fiscal_year"]) & a["sub_period"].eqNullSafe(b["sub_period"]) & a["raw"].eqNullSafe(b["raw"])
    return is_resolved(a) & is_resolved(b) & is_true(F.when(calendar, same).otherwise(inside))


def same_period(a: Column, b: Column) -> Column:
    """Equal type, year and part; the written text doesn't count."""
    return a["period_type"].eqNullSafe(b["period_type"]) & a["fiscal_year"].eqNullSafe(b["fiscal_year"]) & a["sub_period"].eqNullSafe(b["sub_period"])


def describe_period(period: Column, written: Column) -> Column:
    """For readers: 'Q4 FY2024', 'CY2022', 'FY2024', else as written."""
    year = period["fiscal_year"].cast("string")
    named = F.when(period["sub_period"].isNotNull(), F.concat(period["sub_period"], F.lit(" FY"), year)).when(period["period_type"] == "CY", F.concat(F.lit("CY"), year)).otherwise(F.concat(F.lit("FY"), year))
    return F.when(is_resolved(period), named).otherwise(F.trim(F.coalesce(F.nullif(written, F.lit("")), F.lit("an unstated period"))))
