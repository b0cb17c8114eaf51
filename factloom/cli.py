"""Command line: ``python -m factloom.cli {ingest,evaluate,ground} ...`` over a store of snapshots."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.evaluation import metrics, outcome, report
from .operators.extraction import extract_page_facts, replay
from .operators.facts import dedup_facts
from .operators.grounding import ground_quotes
from .functions.identity import fact_id
from .session import ship_package, written
from .sources.labels import load_labels
from .sources.pages import page_ranges, select_pages, text_pages
from .sources.store import SnapshotStore
from .streaming.incremental import reconcile_batch


def numbers(spark: SparkSession, spec: str | None) -> set[int] | None:
    """Page numbers of a selection such as '3-5,9'; None for all."""
    found = spark.range(1).select(page_ranges(F.lit(spec or ""))).first()[0]
    return None if found is None else set(found)


def grounded_facts(pages: DataFrame, extracted: DataFrame, collection: str) -> DataFrame:
    """Facts of extracted pages that are found in their document, with their place."""
    proposed = extracted.select("doc_id", "source_doc", "page_index", F.posexplode("facts").alias("ord", "f")).select("doc_id", "source_doc", "page_index", "ord", "f.*")
    found = ground_quotes(proposed.withColumn("quote", F.col("evidence_span")), pages).where("grounding_method is not null")
    numbers_of = pages.select("doc_id", F.col("page_index").alias("found_on"), F.col("page_number").alias("page"))
    found = found.join(numbers_of, ["doc_id", "found_on"])
    sure = F.when(F.col("grounding_method") == "fuzzy", F.least("confidence", "score")).otherwise(F.col("confidence"))
    named = {f"context_{c}": F.col(c) for c in ("period", "scope", "basis", "vintage")}
    facts = found.withColumns({"collection_id": F.lit(collection), "confidence": sure, **named})
    facts = facts.withColumn("fact_id", fact_id(F.lit(collection), F.col("source_doc"), F.col("attribute"), F.col("value_raw"), F.col("evidence_span")))
    first = dedup_facts(facts, ("page_index", "ord"))  # as the pages and their replies list them
    return first.drop("period", "scope", "basis", "vintage", "quote", "found_on", "page_index", "score", "matched_text", "ord", "repeats")


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    """Read text files with replayed replies, ground and store their facts, reconcile."""
    store = SnapshotStore(spark, args.store)
    pages = text_pages(spark, args.input, args.collection)
    pages = select_pages(pages if args.force else store.new_only("documents", pages), numbers(spark, args.pages), args.max_pages)
    extracted = extract_page_facts(pages, replay(spark.read.json(args.replies)), exact=not args.relaxed)
    facts = written(grounded_facts(pages, extracted, args.collection), "grounded")
    documents = pages.groupBy("doc_id", "source_doc").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    store.upsert("documents", documents.withColumn("collection_id", F.lit(args.collection)))
    store.upsert("collections", spark.createDataFrame([(args.collection, args.collection)], "collection_id string, name string"))
    print(f"{facts.count()} facts grounded")
    reconcile_batch(store, facts, replace_pages=args.force)
    return 0


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Score a collection's facts against a label file."""
    labels = load_labels(spark, args.labels)
    if args.describe:
        print(json.dumps({"shape": labels.shape, "recognised": labels.recognised, "unmapped": labels.unmapped}))
        return 0
    facts = SnapshotStore(spark, args.store).read("facts")
    if facts is None:
        print("nothing is stored", file=sys.stderr)
        return 1
    facts = facts.where(F.col("collection_id") == args.collection).withColumn("fact_ord", F.xxhash64("fact_id"))
    rows = labels.frame(spark)
    matches, misses, spurious = outcome(rows, facts)
    row = metrics(rows, matches, spurious)
    if args.json:
        print(row.toJSON().first())
    else:
        print(report(row, misses, args.show))
    return 0


def ground(spark: SparkSession, args: argparse.Namespace) -> int:
    """Find one quote in the text files of a folder."""
    pages = text_pages(spark, args.input, "cli")
    quotes = pages.select("doc_id").distinct().select("doc_id", F.lit(args.quote).alias("quote"), F.lit(None).cast("int").alias("page_index"))
    found = ground_quotes(quotes, pages, args.min_score).where("grounding_method is not null").toJSON().take(20)
    print("\n".join(found) or "not found")
    return 0 if found else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, function in (("ingest", ingest), ("evaluate", evaluate), ("ground", ground)):
        command = commands.add_parser(name, help=function.__doc__)
        command.set_defaults(function=function)
        if name != "evaluate":
            command.add_argument("--input", required=True)
        if name != "ground":
            command.add_argument("--store", required=True)
            command.add_argument("--collection", default="default")
        if name == "ingest":
            command.add_argument("--replies", required=True, help="JSON lines of prompt_hash and reply")
            command.add_argument("--pages")
            command.add_argument("--max-pages", type=int)
            command.add_argument("--force", action="store_true", help="read known documents again")
            command.add_argument("--relaxed", action="store_true", help="quotes may differ in white space")
        if name == "evaluate":
            command.add_argument("--labels", required=True)
            command.add_argument("--describe", action="store_true")
            command.add_argument("--json", action="store_true")
            command.add_argument("--show", type=int, default=30)
        if name == "ground":
            command.add_argument("--quote", required=True)
            command.add_argument("--min-score", type=float, default=0.85)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    ship_package(spark)
    return args.function(spark, args)


if __name__ == "__main__":
    sys.exit(main())
