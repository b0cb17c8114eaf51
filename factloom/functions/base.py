"""Small building blocks for two-valued text logic on columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def in_slices(values: pa.Array, kind: pa.DataType, make: Callable[[list], list], most: int = 256) -> pa.Array:
    """``make`` of an Arrow column's values, a few at a time, so that few Python objects exist at once however long a batch is."""
    slices = [pa.array(make(values.slice(start, most).to_pylist()), kind) for start in range(0, len(values), most)]
    return pa.concat_arrays(slices) if slices else pa.array([], kind)


def null_text() -> Column:
    return F.lit(None).cast("string")


def blank_to_null(text: Column) -> Column:
    """Trimmed text, or null if nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_true(condition: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(condition, F.lit(False))


def has(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs, Unicode-aware; null text has none."""
    return is_true(text.rlike("(?U)" + pattern))


def part(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, "(?U)" + pattern, group), F.lit(""))


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """One-to-one compatibility foldings of the basic plane, and the few longer ones that documents use."""
    single = [(c, n) for c in map(chr, range(0xA0, 0xFFFF)) if not 0xD800 <= ord(c) < 0xE000 and len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c]
    longer = [(c, unicodedata.normalize("NFKC", c)) for c in "¼½¾…™ŀﬀﬁﬂﬃﬄ№℃"]
    return "".join(a for a, _ in single), "".join(b for _, b in single), tuple(longer)


def compatible(text: Column) -> Column:
    """Compatibility form: full-width, super- and subscript signs, odd spaces and ligatures as plain ones.

    Built from the Unicode tables by rule, evaluated in the JVM. Texts of
    ASCII alone pass untouched.
    """
    old, new, longer = _compatible()

    def folded(t: Column) -> Column:
        out = F.translate(t, old, new)
        for sign, plain in longer:
            out = F.replace(out, F.lit(sign), F.lit(plain))
        return F.when(F.octet_length(t) == F.char_length(t), t).otherwise(out)

    return let(text, folded)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    Without it, every mention repeats the value's whole expression, and nested
    rules grow beyond what the code generator takes.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
