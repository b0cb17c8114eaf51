"""Identifiers, names and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import blank_to_null, collapsed, has, part

DIN = r"(?i)\bdin\b[:\s#-]*([0-9]{8})\b"
_CIN_SHAPE = r"[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}"
CIN = rf"(?i)\b({_CIN_SHAPE})\b"
# Words that carry no identity in a name, and self-references.
SUFFIXES = (
    "limited", "ltd", "pvt", "private", "public", "plc", "inc", "incorporated", "corp", "corporation", "company", "co",
    "llp", "llc", "gmbh", "sa", "nv", "bv", "ag", "spa", "pte", "holdings", "group",
)
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "sri", "sh")
SELF_REFERENCES = (
    "the company", "your company", "our company", "the issuer", "the group", "the bank", "the corporation", "the firm",
    "the organisation", "the organization", "we", "us", "the entity", "the parent",
)
# Address words and their short forms, applied in this order.
ADDRESS_WORDS = (
    ("road", "rd"), ("street", "st"), ("avenue", "ave"), ("floor", "fl"), ("building", "bldg"),
    ("opposite", "opp"), ("near", "nr"), ("number", "no"), ("sector", "sec"), ("phase", "ph"),
)
_IDENTIFIER_ATTRIBUTE = r"(?i)\b(?:din|cin|(?:identification|identity|registration)\s?(?:no|number))\b"


def find_din(*texts: Column) -> Column:
    """Eight digits of the first text that states a director's number."""
    return F.coalesce(*[part(t, DIN) for t in texts])


def find_cin(*texts: Column) -> Column:
    """The first company number stated, in upper case."""
    return F.upper(F.coalesce(*[part(t, CIN) for t in texts]))


def entity_kind(key: Column) -> Column:
    return F.when(key.startswith("DIN:"), "person").when(key.startswith("CIN:"), "organisation")


def is_strong_key(key: Column) -> Column:
    return entity_kind(key).isNotNull()


def _plain_words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores with single spaces."""
    return collapsed(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "))


def normalize_name(name: Column) -> Column:
    """The distinguishing words of a name; empty if there are none."""
    text = F.regexp_replace(_plain_words(name), rf"^(?:(?:{'|'.join(HONORIFICS)})(?: |$))+", "")
    return F.regexp_replace(text, rf"(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$", "")


def is_self_reference(subject: Column) -> Column:
    return _plain_words(subject).isin(*SELF_REFERENCES)


def self_reference_kind(subject: Column) -> Column:
    return F.when(is_self_reference(subject), "organisation")


def normalize_address(address: Column) -> Column:
    text = _plain_words(address)
    for word, short in ADDRESS_WORDS:
        text = F.regexp_replace(text, rf"(?U)\b{word}\b", short)
    return text


def name_key(name: Column) -> Column:
    """'name:' with the normalized name, or null if nothing distinguishes it."""
    return F.concat(F.lit("name:"), F.nullif(normalize_name(name), F.lit("")))


def resolve_subject_key(subject: Column, stated: Column, evidence: Column) -> Column:
    """The strongest key of a subject: a director's number, a company number, another scheme's key, a name."""
    own = blank_to_null(stated)
    return F.coalesce(
        F.concat(F.lit("DIN:"), find_din(stated, subject, evidence)),
        F.concat(F.lit("CIN:"), find_cin(stated, subject, evidence)),
        F.when(own.contains(":"), own),
        name_key(own),
        name_key(subject),
    )


def identifier_stated_by(attribute: Column, value: Column, evidence: Column) -> Column:
    """The key that a fact states for its subject, in its evidence or as the value of an identifier attribute."""
    named = has(F.regexp_replace(F.coalesce(attribute, F.lit("")), r"[_\-]+", " "), _IDENTIFIER_ATTRIBUTE)
    return F.coalesce(
        F.concat(F.lit("DIN:"), find_din(evidence)),
        F.concat(F.lit("CIN:"), find_cin(evidence)),
        F.when(named, F.concat(F.lit("CIN:"), F.upper(part(value, rf"(?i)^\s*({_CIN_SHAPE})\s*$")))),
        F.when(named, F.concat(F.lit("DIN:"), part(value, r"^\s*([0-9]{8})\s*$"))),
    )


