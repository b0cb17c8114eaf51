"""Scoring facts against labels: a theta-join, a greedy one-to-one matching, and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities, periods, units
from ..functions.base import is_true
from ..functions.context import canonical_token
from ..functions.similarity import similarity_join
from ..session import written
from .facts import has_resolved_unit

ATTRIBUTE_THRESHOLD = 0.55
NOT_EXTRACTED, VALUE_MISMATCH = "not_extracted", "value_mismatch"


def document_stem(name: Column) -> Column:
    """A document's name without folders and the last dotted suffix, in lower case."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_replace(base, r"(?<=.)\.[^.]+$", ""))


def subject_matches() -> Column:
    left, right = entities.normalize_name(F.col("l.subject")), entities.normalize_name(F.col("f.subject"))
    return (left == "") | (right == "") | F.contains(left, right) | F.contains(right, left)


def period_matches() -> Column:
    """Whether a label's resolved period is the fact's; unresolved labels accept any."""
    wanted, got = periods.parse_period(F.col("l.period")), F.col("f.signature")["period"]
    return ~periods.is_resolved(wanted) | F.col("f.signature").isNull() | (periods.is_resolved(got) & periods.same_period(wanted, got))


def values_match() -> Column:
    """Equal in comparable units, else as bare numbers, else as text without commas and spaces."""
    written, found = F.col("l.value"), F.col("f.value_raw")
    unit, number, other = units.parse_unit(F.col("l.unit"), written), units.parse_number(written), units.parse_number(found)
    decimals = F.greatest(units.decimals_of(written), units.decimals_of(found))
    comparable = number.isNotNull() & unit.isNotNull() & has_resolved_unit("f.") & (unit["family"] == F.col("f.unit_family")) & (unit["canonical"] == F.col("f.unit_canonical"))

    def plain(text: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[, ]", "")

    return (
        F.when(is_true(comparable), units.values_agree(number * unit["scale"], F.col("f.value_num"), unit["family"], decimals))
        .when(number.isNotNull() & other.isNotNull(), units.values_agree(number, other, F.lit(None).cast("string"), decimals))
        .otherwise((plain(written) != "") & (plain(written) == plain(found)))
    )


def scored_pairs(labels: DataFrame, facts: DataFrame, threshold: float = ATTRIBUTE_THRESHOLD) -> DataFrame:
    """``label_ord, fact_ord, similarity, hit`` of labels and facts whose document, subject and attribute agree.

    Attributes are compared as distinct tokens that share an entry of their
    vectors first, and the join of labels and facts then runs on those tokens,
    so all joins are equi-joins.
    """
    left = labels.withColumn("token", canonical_token(F.col("attribute"))).where("token is not null")
    right = facts.withColumn("token", canonical_token(F.col("attribute"))).where("token is not null")
    spoken = {s: df.select(F.col("token").alias(f"token_{s}"), F.replace("token", F.lit("_"), F.lit(" ")).alias(s)).distinct() for s, df in (("l", left), ("f", right))}
    alike = similarity_join(spoken["l"], "l", spoken["f"], "f", threshold, "similarity").select("token_l", "token_f", "similarity")
    l = left.select(F.col("token").alias("token_l"), "label_ord", F.struct(*left.columns).alias("l")).join(alike, "token_l")
    f = right.select(F.col("token").alias("token_f"), "fact_ord", F.struct(*right.columns).alias("f"), F.lower(F.coalesce("source_doc", F.lit(""))).alias("stem"))
    # labels that name a document only meet its facts
    named = F.coalesce("l.document", F.lit("")) != ""
    pairs = l.where(named).withColumn("stem", document_stem(F.col("l.document"))).join(f, ["token_f", "stem"])
    pairs = pairs.unionByName(l.where(~named).join(f, "token_f").select(*pairs.columns)).where(subject_matches())
    hit = values_match() & period_matches()
    agrees = (F.size(F.coalesce("l.pages", F.array().cast("array<int>"))) <= 0) | is_true(F.array_contains("l.pages", F.col("f.page")))
    return pairs.select("label_ord", "fact_ord", "similarity", hit.alias("hit"), agrees.alias("page_agrees"))


def greedy_matching(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 40) -> DataFrame:
    """Edges of the one-to-one matching that takes the most similar pair first (label_ord, fact_ord, similarity).

    Ties go to the smaller label_ord, then fact_ord. Each round takes all edges
    that come first for both their ends, which are just those that the
    sequential choice would take, and drops the edges of used ends. Tied blocks
    and descending chains may yield one pair a round; what ``rounds`` leave over
    is chosen one by one in order, in one task that holds the used ends only.
    """
    keep = keep or _kept
    order = [F.desc("similarity"), "label_ord", "fact_ord"]
    left, taken = edges.select("label_ord", "fact_ord", "similarity"), None
    for _ in range(rounds):
        ranked = keep(left.withColumns({k: F.row_number().over(Window.partitionBy(c).orderBy(*order)) for k, c in (("rl", "label_ord"), ("rf", "fact_ord"))}))
        best = ranked.where("rl = 1 and rf = 1").drop("rl", "rf")
        if best.isEmpty():
            break
        taken = best if taken is None else taken.unionByName(best)
        left = ranked.drop("rl", "rf").join(best.select("label_ord"), "label_ord", "left_anti").join(best.select("fact_ord"), "fact_ord", "left_anti")
    else:
        rest = keep(left.select("label_ord", "fact_ord", "similarity").repartition(1).sortWithinPartitions(*order).mapInArrow(_chosen, edges.select("label_ord", "fact_ord", "similarity").schema))
        taken = rest if taken is None else taken.unionByName(rest)
    return edges.select("label_ord", "fact_ord", "similarity").limit(0) if taken is None else taken


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges in order, those whose ends no earlier one has used."""
    labels, facts = set(), set()
    for batch in batches:
        good = []
        for label, fact in zip(batch.column("label_ord").to_pylist(), batch.column("fact_ord").to_pylist()):
            good.append(label not in labels and fact not in facts)
            if good[-1]:
                labels.add(label)
                facts.add(fact)
        yield batch.filter(pa.array(good, pa.bool_()))


def _kept(df: DataFrame) -> DataFrame:
    return written(df, "edges")


def outcome(labels: DataFrame, facts: DataFrame, threshold: float = ATTRIBUTE_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, misses and spurious facts of labels (label_ord, ...) and facts (fact_ord, ...)."""
    pairs = _kept(scored_pairs(labels, facts, threshold))
    taken = greedy_matching(pairs.where("hit"))
    matches = taken.join(pairs.select("label_ord", "fact_ord", "page_agrees"), ["label_ord", "fact_ord"])
    near = pairs.groupBy("label_ord").agg(F.max_by("fact_ord", F.struct("similarity", -F.col("fact_ord"))).alias("nearest"))
    misses = labels.select("label_ord").join(taken.select("label_ord"), "label_ord", "left_anti").join(near, "label_ord", "left")
    misses = misses.withColumn("cause", F.when(F.col("nearest").isNull(), NOT_EXTRACTED).otherwise(VALUE_MISMATCH))
    labelled = labels.select(canonical_token(F.col("attribute")).alias("token")).where("token is not null").distinct().withColumn("scoped", F.lit(True))
    spurious = facts.join(taken.select("fact_ord"), "fact_ord", "left_anti").withColumn("token", canonical_token(F.col("attribute")))
    spurious = spurious.join(labelled, "token", "left").select("fact_ord", F.coalesce("scoped", F.lit(False)).alias("scoped"))
    return matches, misses, spurious


def metrics(labels: DataFrame, matches: DataFrame, spurious: DataFrame) -> DataFrame:
    """One row: counts, recall, precision, precision within labelled attributes, and the F1 of that and recall."""
    row = labels.agg(F.count(F.lit(1)).alias("labels")).join(F.broadcast(matches.agg(F.count(F.lit(1)).alias("tp"))))
    row = row.join(F.broadcast(spurious.agg(F.count(F.lit(1)).alias("spurious"), F.count_if("scoped").alias("scoped_spurious"))))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    row = row.withColumns({"recall": ratio(F.col("tp"), F.col("labels")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("spurious")), "scoped_precision": ratio(F.col("tp"), F.col("tp") + F.col("scoped_spurious"))})
    return row.withColumn("f1", ratio(2 * F.col("scoped_precision") * F.col("recall"), F.col("scoped_precision") + F.col("recall")))


def report(metrics_row: DataFrame, misses: DataFrame, show: int = 30) -> str:
    """Text report of an evaluation; lists at most ``show`` misses."""
    m = metrics_row.first()
    lines = [f"labels {m.labels}, matched {m.tp}, spurious {m.spurious}", f"recall {m.recall:.3f}  precision {m.precision:.3f}  in labelled attributes {m.scoped_precision:.3f}  f1 {m.f1:.3f}"]
    lines += [f"missed label {r.label_ord}: {r.cause}" for r in misses.orderBy("label_ord").limit(show).collect()]
    return "\n".join(lines)
