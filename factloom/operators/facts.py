"""Shapes and predicates of facts, and their normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import context, entities, units
from ..functions.base import blank_to_null, is_true, null_text
from ..session import written

#: Tasks over which the facts of one key are dealt where they join a table of one row a key.
DEALT = 64
#: Confidence of a measurement whose unit doesn't resolve is at most this.
UNRESOLVED_CAP = 0.4
#: Columns that normalization reads; absent ones are taken as null.
WRITTEN = {
    "collection_id": "string", "doc_id": "string", "fact_id": "string", "source_doc": "string", "page": "int", "subject": "string", "subject_key": "string",
    "attribute": "string", "attribute_raw": "string", "category": "string", "value_raw": "string", "unit": "string", "unit_raw": "string",
    "context_period": "string", "context_scope": "string", "context_basis": "string", "context_vintage": "string",
    "evidence_span": "string", "confidence": "double", "grounding_method": "string",
}
# Attributes that state whether a director is on the board, the first that fits wins.
BOARD_STATUS = (("resigned", r"resign|cessation|ceased|demitted|stepped\s?down"), ("active", r"\b(?:designation|appointment|role|position)\b"))


def completed(facts: DataFrame) -> DataFrame:
    """``facts`` with every written column; an absent confidence is 0.5."""
    missing = {c: F.lit(None).cast(t) for c, t in WRITTEN.items() if c not in facts.columns}
    if "confidence" in missing:
        missing["confidence"] = F.lit(0.5)
    return facts.withColumns(missing) if missing else facts


def is_grounded(prefix: str = "") -> Column:
    return F.col(prefix + "page").isNotNull() & F.col(prefix + "grounding_method").isNotNull()


def has_resolved_unit(prefix: str = "") -> Column:
    return F.col(prefix + "unit_canonical").isNotNull() & F.col(prefix + "value_num").isNotNull()


def is_categorical(prefix: str = "", parsed: bool = False) -> Column:
    """A state rather than a quantity: no resolved unit, and a category or a value without a single number.

    ``parsed``: the facts carry ``one_number`` from their normalization.
    """
    value = F.col(prefix + "value_raw")
    number = F.col(prefix + "one_number") if parsed else units.parse_number(value).isNotNull()
    stated = blank_to_null(F.col(prefix + "category")).isNotNull() | (blank_to_null(value).isNotNull() & ~number)
    return ~has_resolved_unit(prefix) & is_true(stated)


def resolve(facts: DataFrame) -> DataFrame:
    """Row-wise part: unit, base value, context signature, subject key, capped confidence."""
    value = F.col("value_raw")
    facts = completed(facts).withColumns({"__unit": units.parse_unit(F.col("unit"), value), "__number": units.parse_number(value)})
    facts = facts.withColumns(
        {
            "unit_raw": F.coalesce(F.nullif("unit_raw", F.lit("")), "unit"),
            "unit_canonical": F.col("__unit.canonical"),
            "unit_family": F.col("__unit.family"),
            "value_num": F.col("__number") * F.col("__unit.scale"),
            "signature": context.build_signature(*[F.col(f"context_{f}") for f in context.CONTEXT_FIELDS]),
            "subject_key": entities.resolve_subject_key(F.col("subject"), F.col("subject_key"), F.col("evidence_span")),
            "normalized": F.lit(True),
            "decimals": units.decimals_of(value),
            "one_number": F.col("__number").isNotNull(),
        }
    ).drop("__unit", "__number")
    capped = F.when(~is_categorical(parsed=True) & ~has_resolved_unit(), F.least("confidence", F.lit(UNRESOLVED_CAP)))
    return facts.withColumn("confidence", F.coalesce(capped, "confidence"))


def dominant_entities(facts: DataFrame, batch: str = "source_doc", kind: str = "organisation", order: tuple[str, ...] = ("page", "fact_id")) -> DataFrame:
    """``batch, dominant``: the key that most of a document's facts are about, stated identifiers first.

    Keys of another kind than ``kind`` don't count; ties go to the key seen
    first. An aggregate, so no task sees all keys of a document.
    """
    key = F.col("subject_key")
    fits = key.isNotNull() & ~entities.is_self_reference(F.col("subject")) & is_true(F.coalesce(entities.entity_kind(key), F.lit(kind)) == kind)
    seen = F.min(F.struct(*order)).alias("seen")
    counts = facts.where(fits).groupBy(batch, "subject_key").agg(F.count(F.lit(1)).alias("n"), seen)
    rank = F.struct((~entities.is_strong_key(key)).alias("weak"), (-F.col("n")).alias("n"), "seen", "subject_key")
    return counts.groupBy(batch).agg(F.min(rank)["subject_key"].alias("dominant"))


def dealt_join(facts: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``facts`` left-joined with a table of one row a key, each of whose rows meets its facts in ``DEALT`` places."""
    dealt = F.pmod(F.xxhash64("fact_id", "value_raw", "evidence_span"), F.lit(DEALT))
    copies = known.withColumn("__dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    return facts.withColumn("__dealt", dealt).join(copies, [*keys, "__dealt"], "left").drop("__dealt")


def bind_self_references(facts: DataFrame, batch: str = "source_doc", order: tuple[str, ...] = ("page", "fact_id")) -> DataFrame:
    """'the Company' and its like take the key that their document is mostly about. Other facts aren't moved."""
    self_reference = entities.is_self_reference(F.col("subject"))
    own = facts.where(self_reference)
    if own.isEmpty():
        return facts
    bound = dealt_join(own, dominant_entities(facts, batch, order=order), [batch])
    bound = bound.withColumn("subject_key", F.coalesce("dominant", "subject_key")).select(*facts.columns)
    return facts.where(~self_reference).unionByName(bound)


def stated_keys(facts: DataFrame, batch: str = "source_doc") -> DataFrame:
    """``batch, name, stated``: names for which a batch states exactly one identifier."""
    stated = entities.identifier_stated_by(F.col("attribute"), F.col("value_raw"), F.col("evidence_span"))
    claims = facts.select(batch, entities.name_key(F.col("subject")).alias("name"), stated.alias("stated")).where("name is not null and stated is not null")
    sides = claims.groupBy(batch, "name").agg(F.min("stated").alias("stated"), F.max("stated").alias("other"))
    return sides.where("stated = other").drop("other")


def bind_strong_keys(facts: DataFrame, batch: str = "source_doc") -> DataFrame:
    """Name keys become the identifier that their batch states for that name. Facts with other keys aren't moved."""
    is_named = is_true(F.col("subject_key").startswith("name:"))
    named = facts.where(is_named)
    if named.isEmpty():
        return facts
    claims = stated_keys(facts, batch).withColumnRenamed("name", "subject_key")
    bound = dealt_join(named, claims, [batch, "subject_key"])
    bound = bound.withColumn("subject_key", F.coalesce("stated", "subject_key")).select(*facts.columns)
    return facts.where(~is_named).unionByName(bound)


def map_board_status(facts: DataFrame) -> DataFrame:
    """Facts on a director's office share one attribute and have a category; a second pass changes nothing."""
    original = F.coalesce(F.nullif("attribute_raw", F.lit("")), "attribute")
    words = F.regexp_replace(F.lower(original), r"[_\-]+", " ")
    status = null_text()
    for name, pattern in reversed(BOARD_STATUS):
        status = F.when(is_true(words.rlike("(?U)" + pattern)), name).otherwise(status)
    facts = facts.withColumn("__status", F.when(F.col("subject_key").startswith("DIN:"), status))
    held = F.col("__status").isNotNull()
    return facts.withColumns(
        {
            "attribute_raw": F.when(held, original).otherwise(F.col("attribute_raw")),
            "attribute": F.when(held, "board_status").otherwise(F.col("attribute")),
            "category": F.coalesce("__status", "category"),
        }
    ).drop("__status")


def normalize_facts(facts: DataFrame, batch: str = "source_doc", order: tuple[str, ...] = ("page", "fact_id")) -> DataFrame:
    """Resolve every fact, then bind self-references, stated identifiers and board offices, in this order.

    Resolved facts are kept as a table, since the bindings read them more than
    once and parsing is the costly part.
    """
    resolved = written(resolve(facts), "resolved")
    bound = bind_strong_keys(bind_self_references(resolved, batch, order), batch)
    return map_board_status(bound)


def dedup_facts(facts: DataFrame, order: tuple[str, ...] = ("page", "ord")) -> DataFrame:
    """The first of the facts that share an id within their document; ``repeats`` counts the others.

    An aggregate, which reduces a fact that is repeated often within each task.
    """
    rows = facts.select("fact_id", F.struct(*order).alias("__order"), F.struct(*facts.columns).alias("__row"))
    firsts = rows.groupBy("fact_id").agg(F.min_by("__row", "__order").alias("__row"), (F.count(F.lit(1)) - 1).alias("repeats"))
    return firsts.select("__row.*", "repeats")
