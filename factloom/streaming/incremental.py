"""Incremental reconciliation: micro-batches of facts against all that is stored.

The store's content keys make every step repeatable. A batch's relationships
are stored before its facts, so facts that are stored have theirs: a batch that
failed half way still counts as new when it is replayed, and one that is done
changes nothing. The pool isn't a stream: facts have no event time that would
bound a stream-to-stream join, so each batch joins the stored table. Batches
of new facts are added to the stored tables, which aren't written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import normalize_facts
from ..operators.matching import find_candidates
from ..operators.verdicts import judge, relationships
from ..session import written
from ..sources.store import SnapshotStore


def reconcile_batch(store: SnapshotStore, facts: DataFrame, replace_pages: bool = False) -> None:
    """Store a batch of written facts and the relationships in which they take part.

    With ``replace_pages`` the batch takes the place of all facts stored for
    the pages that it has.
    """
    known = store.read("facts")
    if replace_pages and known is not None:
        normalized = written(normalize_facts(facts), "batch")
        known = known.join(facts.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
        version = pool = written(store.merged("facts", normalized, known), "pool")
        pairs = find_candidates(pool, new_fact_ids=normalized.select("fact_id"))
    else:
        version = store.stage("facts", normalize_facts(facts))
        if known is None:
            pairs = find_candidates(version.rows)
        elif version.before is None:
            pairs = find_candidates(version.rows, new_fact_ids=version.incoming.select("fact_id"))
        else:
            pool = version.before.withColumn("is_new", F.lit(False)).unionByName(version.incoming.withColumn("is_new", F.lit(True)))
            pairs = find_candidates(pool)
    store.upsert("relationships", relationships(judge(pairs)))
    store.publish("facts", version)


def new_facts_only(store: SnapshotStore, facts: DataFrame) -> DataFrame:
    """Facts that the store doesn't have yet, of documents known and new."""
    return store.new_only("facts", facts)


def reconcile_stream(store: SnapshotStore, facts: DataFrame, checkpoint: str, skip_known: bool = True, once: bool = True) -> StreamingQuery:
    """Run a stream of written facts into the store; ``once`` works off what is there and ends.

    ``skip_known`` leaves facts alone that are stored, else they are updated.
    """

    def handle(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        try:
            reconcile_batch(store, new_facts_only(store, rows) if skip_known else rows)
        finally:
            rows.unpersist()

    writer = facts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_report(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Counters of each document: pages (doc_id, error, proposed, unverbatim), facts (doc_id, outcome, resolved).

    ``outcome`` is 'stored', 'ungrounded' or 'duplicate'.
    """
    read = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_processed"),
        F.count_if(F.col("error").isNotNull()).alias("pages_failed"),
        F.sum("proposed").alias("proposed"),
        F.sum("unverbatim").alias("unverbatim"),
    )
    kept = facts.groupBy("doc_id").agg(
        F.count_if(F.col("outcome") == "stored").alias("grounded"),
        F.count_if(F.col("outcome") == "ungrounded").alias("dropped_ungrounded"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if((F.col("outcome") == "stored") & ~F.col("resolved")).alias("unresolved_units"),
    )
    both = read.join(kept, "doc_id", "left").na.fill(0)
    return both.withColumn("grounding_rate", F.round(F.coalesce(F.try_divide(F.col("grounded").cast("double"), F.col("proposed")), F.lit(0.0)), 4))
