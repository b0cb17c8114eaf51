"""The read API: what each endpoint answers, as frames of nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.presentation import escape_html
from ..operators.facts import has_resolved_unit
from .store import SnapshotStore, collection_counts, count_by_verdict, document_counts, filter_facts, filter_relationships, with_facts

MAX_ROWS = 5000


class NotFound(LookupError):
    """No such collection or fact."""


def fact_row(prefix: str = "") -> Column:
    """A fact as clients get it: nested context, signature and grounding."""

    def c(name: str) -> Column:
        return F.col(prefix + name)

    context = F.struct(*[c(f"context_{f}").alias(f) for f in ("period", "scope", "basis", "vintage")]).alias("context")
    flat = [c(f).alias(f) for f in ("fact_id", "collection_id", "doc_id", "source_doc", "subject", "subject_key", "attribute", "value_raw", "value_num", "unit", "unit_canonical", "unit_family", "page", "evidence_span", "confidence")]
    url = F.concat(F.lit("/facts/"), c("fact_id"), F.lit("/evidence")).alias("evidence_url")
    return F.struct(*flat, context, c("signature").alias("signature"), c("grounding_method").alias("grounding_method"), has_resolved_unit(prefix).alias("comparable"), url)


def checked_limit(limit: int, most: int = MAX_ROWS) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must lie between 1 and {most}")
    return limit


class ReadApi:
    """Answers over a snapshot store."""

    def __init__(self, store: SnapshotStore):
        self.store = store

    def _table(self, name: str) -> DataFrame:
        rows = self.store.read(name)
        if rows is None:
            raise NotFound(f"no {name} stored")
        return rows

    def collections(self) -> DataFrame:
        counts = collection_counts(self._table("collections"), self._table("documents"), self._table("facts"))
        return counts.orderBy("created_at", "collection_id")

    def collection(self, collection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """A collection's row, its documents with fact counts, and its verdict counts."""
        row = self.collections().where(F.col("collection_id") == collection)
        if row.isEmpty():
            raise NotFound(collection)
        documents = document_counts(self._table("documents").where(F.col("collection_id") == collection), self._table("facts"))
        verdicts = count_by_verdict(self._table("relationships").where(F.col("collection_id") == collection))
        return row, documents.orderBy("created_at", "doc_id"), verdicts

    def facts(self, collection: str, limit: int = MAX_ROWS, **filters: str | None) -> DataFrame:
        found = filter_facts(self._table("facts"), collection, limit=checked_limit(limit), **filters)
        return found.select(fact_row().alias("fact")).select("fact.*")

    def fact(self, fact: str) -> DataFrame:
        row = self._table("facts").where(F.col("fact_id") == fact).limit(1)
        if row.isEmpty():
            raise NotFound(fact)
        return row.select(fact_row().alias("fact")).select("fact.*")

    def relationships(self, collection: str, limit: int = MAX_ROWS, **filters: str | None) -> tuple[DataFrame, DataFrame]:
        """Relationships with their facts, and the totals of all verdicts, whatever the filter."""
        rows = self._table("relationships")
        found = filter_relationships(rows, collection, limit=checked_limit(limit), **filters)
        return with_facts(found, self._table("facts")), count_by_verdict(rows.where(F.col("collection_id") == collection))

    def debug_html(self, collection: str, limit: int = 100) -> str:
        """A page of facts for a browser; a bounded report built on the driver."""
        found = filter_facts(self._table("facts"), collection, limit=checked_limit(limit, 1000))
        cells = F.concat(*[F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in ("subject", "attribute", "value_raw", "source_doc", "page")])
        rows = [r[0] for r in found.select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))).collect()]
        return "<table>" + "".join(rows) + "</table>"
