"""Reading model replies as facts, and the gates that proposed facts must pass.

The model is a boundary: ``Proposer`` is any callable from a frame of prompts
to a frame of replies. ``replay`` answers from a table, which makes runs
repeatable and needs no network.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import in_slices, trimmed
from ..functions.identity import text_hash
from ..functions.units import has_digit, numeric_claim
from ..session import written
from .grounding import is_verbatim

#: Takes a frame with a ``prompt`` column and adds ``reply`` (null where the model failed) and ``error``.
Proposer = Callable[[DataFrame], DataFrame]
# Keys under which a model may wrap its list.
WRAPPERS = ("facts", "results", "data", "items")
FACT_FIELDS = ("subject", "subject_key", "attribute", "value_raw", "unit", "period", "scope", "basis", "vintage", "evidence_span")
_FACT = T.StructType([*(T.StructField(f, T.StringType()) for f in FACT_FIELDS), T.StructField("confidence", T.DoubleType())])
PAYLOAD = T.StructType([T.StructField("error", T.StringType()), T.StructField("facts", T.ArrayType(_FACT))])
_ARROW_FACT = pa.struct([*((f, pa.string()) for f in FACT_FIELDS), ("confidence", pa.float64())])
_ARROW_PAYLOAD = pa.struct([("error", pa.string()), ("facts", pa.list_(_ARROW_FACT))])


def strip_code_fences(text: Column) -> Column:
    """Without a fence line at the start and fence lines at the end."""
    body = F.regexp_replace(trimmed(text), r"^```[^\n]*\n?", "")
    return trimmed(F.regexp_replace(body, r"(?:\s*```)+\s*$", ""))


def outermost_block(text: str, opener: str, closer: str) -> str | None:
    """The first balanced block between two brackets; brackets within JSON strings don't count."""
    start = text.find(opener)
    depth, quoted, skip = 0, False, False
    for i, sign in enumerate(text[start:] if start >= 0 else ""):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = sign == "\\", sign != '"'
        elif sign == '"':
            quoted = True
        else:
            depth += (sign == opener) - (sign == closer)
            if not depth:
                return text[start : start + i + 1]
    return None


def read_json(text: str | None, blocks: tuple[tuple[str, str], ...]) -> object:
    """A reply's JSON, whole or as the first kind of bracketed block found in it; ValueError if there is none."""
    if not (text or "").strip():
        raise ValueError("empty response")
    try:
        return json.loads(text)
    except ValueError:
        block = next((b for b in (outermost_block(text, *pair) for pair in blocks) if b), None)
        if block is None:
            raise ValueError("no JSON found in response") from None
        return json.loads(block)


def coerce_fact(raw: object) -> dict | None:
    """A proposed fact with trimmed fields, or None if it lacks one that every fact needs."""
    if not isinstance(raw, dict):
        return None

    def text(source: dict, name: str, numbers: bool) -> str | None:
        value = source.get(name)
        value = str(value) if numbers and isinstance(value, (int, float)) else value
        return (value.strip() or None) if isinstance(value, str) else None

    around = raw["context"] if isinstance(raw.get("context"), dict) else raw
    fact = {f: text(around, f, False) if f in ("period", "scope", "basis", "vintage") else text(raw, f, True) for f in FACT_FIELDS}
    if not all(fact[f] for f in ("subject", "attribute", "value_raw", "evidence_span")):
        return None
    try:
        stated = float(raw.get("confidence", 0.5))
    except (TypeError, ValueError):
        stated = 0.5
    return fact | {"confidence": max(0.0, min(1.0, stated))}


def payload_facts(text: str | None) -> list[dict]:
    payload = read_json(text, (("[", "]"),))
    if isinstance(payload, dict):
        payload = next((payload[k] for k in WRAPPERS if isinstance(payload.get(k), list)), [payload])
    if not isinstance(payload, list):
        raise ValueError("expected a list of facts")
    return [fact for fact in map(coerce_fact, payload) if fact]


def _payload(text: str | None) -> dict:
    try:
        return {"error": None, "facts": payload_facts(text)}
    except ValueError as problem:
        return {"error": str(problem), "facts": []}


@F.arrow_udf(PAYLOAD)
def parse_payload(reply: pa.Array) -> pa.Array:
    """``struct<error, facts>`` of replies whose code fences are gone."""
    return in_slices(reply, _ARROW_PAYLOAD, lambda texts: list(map(_payload, texts)))


def replay(replies: DataFrame) -> Proposer:
    """A proposer that answers from ``replies`` (prompt_hash, reply); unknown prompts get an error."""
    known = replies.select("prompt_hash", "reply").dropDuplicates(["prompt_hash"])

    def propose(prompts: DataFrame) -> DataFrame:
        answered = prompts.withColumn("prompt_hash", text_hash(F.col("prompt"))).join(known, "prompt_hash", "left")
        return answered.withColumn("error", F.when(F.col("reply").isNull(), "no reply")).drop("prompt_hash")

    return propose


def build_prompt(page_text: Column, source_doc: Column, page_number: Column) -> Column:
    return F.concat(F.lit("Document: "), source_doc, F.lit("\nPage: "), page_number.cast("string"), F.lit("\n\n"), page_text)


#: Added to the prompt of a page whose reply couldn't be read.
REMINDER = "\n\nReply with a JSON list of facts and nothing else."


def _answered(asked: DataFrame, propose: Proposer) -> DataFrame:
    """Replies with their payloads. They are a table, so that no call is made again when an executor is lost."""
    return written(propose(asked), "replies").withColumn("payload", parse_payload(strip_code_fences(F.col("reply"))))


def flag_facts(facts: DataFrame, page_text: Column, exact: bool = True, digits: bool = True) -> DataFrame:
    """Proposed facts with ``verbatim`` and ``valued``: whether their page says the quote, and a unit has a number."""
    valued = ~numeric_claim(F.col("unit")) | has_digit(F.col("value_raw")) if digits else F.lit(True)
    return facts.withColumns({"verbatim": is_verbatim(F.col("evidence_span"), page_text, exact), "valued": valued})


def extract_page_facts(pages: DataFrame, propose: Proposer, exact: bool = True) -> DataFrame:
    """Facts of ``pages`` (doc_id, source_doc, page_index, page_number, text), one row a page.

    ``facts`` are those that pass both gates; ``unverbatim`` and ``valueless``
    count the others; pages whose reply can't be read have an ``error`` after
    one more try, and no invented facts. Blank pages aren't sent.
    """
    asked = pages.where(trimmed(F.coalesce("text", F.lit(""))) != "").withColumn("prompt", build_prompt(F.col("text"), F.col("source_doc"), F.col("page_number")))
    parsed = _answered(asked, propose)
    unread = parsed.where("error is null and payload.error is not null").select(*pages.columns, F.concat("prompt", F.lit(REMINDER)).alias("prompt"))
    again = _answered(unread, propose).where("error is null and payload.error is null")
    named = [F.col(c) for c in pages.columns]
    keys = [c for c in ("doc_id", "page_index") if c in pages.columns]
    parsed = parsed.join(again.select(*keys), keys, "left_anti").select(*named, "error", "payload").unionByName(again.select(*named, "error", "payload"))
    gates = F.transform(
        "payload.facts",
        lambda f: F.struct(f.alias("fact"), is_verbatim(f["evidence_span"], F.col("text"), exact).alias("verbatim"), (~numeric_claim(f["unit"]) | has_digit(f["value_raw"])).alias("valued")),
    )
    gated = parsed.withColumn("gates", gates)
    return gated.select(
        *pages.columns,
        F.coalesce("error", "payload.error").alias("error"),
        F.transform(F.filter("gates", lambda g: g["verbatim"] & g["valued"]), lambda g: g["fact"]).alias("facts"),
        F.size(F.filter("gates", lambda g: ~g["verbatim"])).alias("unverbatim"),
        F.size(F.filter("gates", lambda g: g["verbatim"] & ~g["valued"])).alias("valueless"),
    )
