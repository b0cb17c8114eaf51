"""Queries over facts that three publishers state about the same customers.

The facts are written as text (values in lakh, million or plain, periods in
several notations) and go through the whole engine. The SQL twins judge the
same pairs from the integers and codes that the texts were made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import fact_id
from ..operators.facts import completed, dominant_entities, normalize_facts
from ..operators.matching import candidate_rows, find_candidates
from ..operators.verdicts import judge, reason_text, relationships
from ..sources.store import count_by_verdict, filter_facts, filter_relationships, with_facts
from ..session import written
from .registry import query, sql

#: Codes of each fact: customer c, publisher o (0 to 2), fiscal year fy, amount in whole units. Runs in both engines.
_CODES = """
    s AS (SELECT o_custkey AS c, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INT) AS o,
        CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS INT) AS fy, CAST(floor(o_totalprice) AS BIGINT) AS v FROM {orders}),
    t AS (SELECT c, fy, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY c, fy),
    p AS (SELECT DISTINCT c, o, fy FROM s),
    k AS (SELECT p.c, p.o, p.fy, CAST(floor(total * (1000 + CASE (p.c * 3 + p.fy + p.o) % 4 WHEN 2 THEN 3 WHEN 3 THEN 40 ELSE 0 END) / 1000) AS BIGINT) AS amount
        FROM p JOIN t ON p.c = t.c AND p.fy = t.fy)"""

_WRITTEN = f"""WITH {_CODES},
    w AS (SELECT *, CAST(floor(amount / 1000) AS BIGINT) AS th, lpad(CAST(c AS STRING), 6, '0') AS c6 FROM k)
    SELECT 'customers' AS collection_id, 'doc' || o AS doc_id, 'f' || o || '_' || fy || '_' || c6 AS fact_id, 'publisher ' || o AS source_doc, CAST(1 + c % 50 AS INT) AS page,
        CASE o WHEN 0 THEN 'Customer ' || c || ' Ltd.' WHEN 1 THEN 'customer ' || c || ' Limited' ELSE 'CUSTOMER ' || c END AS subject, CAST(NULL AS STRING) AS subject_key,
        CASE o WHEN 1 THEN 'total price' ELSE 'total_price' END AS attribute,
        CASE WHEN o = 1 AND c % 2 = 0 THEN CAST(floor(th / 100) AS BIGINT) || '.' || lpad(CAST(th % 100 AS STRING), 2, '0')
            WHEN o = 2 AND c % 3 = 2 THEN CAST(floor(th / 1000) AS BIGINT) || '.' || lpad(CAST(th % 1000 AS STRING), 3, '0') ELSE CAST(amount AS STRING) END AS value_raw,
        CASE o WHEN 0 THEN '₹' WHEN 1 THEN CASE WHEN c % 2 = 0 THEN 'INR lakh' ELSE '₹' END ELSE CASE c % 3 WHEN 1 THEN 'USD' WHEN 2 THEN '₹ mn' END END AS unit,
        CASE o WHEN 0 THEN 'FY' || fy WHEN 1 THEN (fy - 1) || '-' || lpad(CAST(fy % 100 AS STRING), 2, '0') ELSE CASE WHEN c % 4 = 0 THEN 'Q4 FY' || fy ELSE 'FY' || fy END END AS context_period,
        CASE o WHEN 0 THEN CASE WHEN c % 5 <> 0 THEN 'Consolidated' END WHEN 1 THEN CASE WHEN c % 7 = 0 THEN 'standalone' ELSE 'consolidated basis' END ELSE 'Consolidated' END AS context_scope,
        CAST(NULL AS STRING) AS context_basis,
        CASE WHEN c % 6 = 0 AND o = 0 THEN 'Provisional estimate' WHEN c % 6 = 0 AND o = 1 THEN 'Revised' END AS context_vintage,
        'CIN L00001MH1995PLC' || c6 || ' row ' || fy AS evidence_span, CASE o WHEN 0 THEN 0.9D WHEN 1 THEN 0.8D ELSE 0.7D END AS confidence, 'normalized' AS grounding_method
    FROM w"""

#: The same facts as codes that a judge can read: base value, decimals, unit, period, scope, vintage.
_READ = f"""WITH {_CODES.replace("{orders}", "orders")},
    r AS (SELECT c, o, fy, 'f' || o || '_' || fy || '_' || lpad(CAST(c AS VARCHAR), 6, '0') AS id,
        CASE WHEN o = 1 AND c % 2 = 0 OR o = 2 AND c % 3 = 2 THEN amount // 1000 * 1000 ELSE amount END AS base,
        CASE WHEN o = 1 AND c % 2 = 0 THEN 2 WHEN o = 2 AND c % 3 = 2 THEN 3 ELSE 0 END AS decimals,
        CASE o WHEN 0 THEN '₹' WHEN 1 THEN CASE WHEN c % 2 = 0 THEN 'INR lakh' ELSE '₹' END ELSE CASE c % 3 WHEN 1 THEN 'USD' WHEN 2 THEN '₹ mn' END END AS unit,
        CASE WHEN o = 2 AND c % 3 = 1 THEN 'USD' WHEN o = 2 AND c % 3 = 0 THEN NULL ELSE 'INR' END AS canonical,
        NOT (o = 1 AND fy = 2000) AS resolved, CASE WHEN o = 2 AND c % 4 = 0 THEN 'Q4' END AS sub,
        CASE o WHEN 0 THEN CASE WHEN c % 5 <> 0 THEN 'consolidated' END WHEN 1 THEN CASE WHEN c % 7 = 0 THEN 'standalone' ELSE 'consolidated' END ELSE 'consolidated' END AS scope,
        CASE WHEN c % 6 = 0 AND o = 0 THEN 'provisional' WHEN c % 6 = 0 AND o = 1 THEN 'revised' END AS vintage,
        CASE WHEN o = 2 AND c % 3 = 0 THEN 0.4 WHEN o = 0 THEN 0.9 WHEN o = 1 THEN 0.8 ELSE 0.7 END AS confidence
        FROM k),
    pairs AS (SELECT a.c, a.id AS fact_a, b.id AS fact_b, a.o AS oa, b.o AS ob, a.fy AS fya, b.fy AS fyb, a.base AS va, b.base AS vb, a.unit AS ua, b.unit AS ub, a.canonical AS ca, b.canonical AS cb,
        greatest(a.decimals, b.decimals) AS decimals, a.vintage AS vta, b.vintage AS vtb,
        a.resolved AND b.resolved AND (a.fy <> b.fy OR a.sub IS DISTINCT FROM b.sub) AS dp, a.resolved AND b.resolved AND a.fy = b.fy AND a.sub IS DISTINCT FROM b.sub AS nested,
        coalesce(a.scope <> b.scope, FALSE) AS ds, coalesce(a.vintage <> b.vintage, FALSE) AS dv,
        a.resolved <> b.resolved AS up, (a.scope IS NULL) <> (b.scope IS NULL) AS us, (a.vintage IS NULL) <> (b.vintage IS NULL) AS uv, least(a.confidence, b.confidence) AS confidence
        FROM r a JOIN r b ON a.c = b.c AND a.o < b.o),
    coded AS (SELECT *, CASE WHEN ca IS NULL OR cb IS NULL THEN 'unit_missing' WHEN ca <> cb THEN 'unit_incomparable' WHEN dp AND nested THEN 'period_subset' WHEN dp THEN 'period_diff'
        WHEN ds THEN 'scope_diff' WHEN dv THEN 'vintage_revision'
        WHEN abs(va - vb) <= greatest(0.005 * greatest(va, vb), pow(10.0, -decimals)) + 1e-12 THEN CASE WHEN ua <> ub THEN 'unit_diff_resolved' ELSE 'same_value' END
        WHEN up OR us OR uv THEN 'context_unstated' ELSE 'value_conflict' END AS reason_code FROM pairs),
    judged AS (SELECT *, CASE WHEN reason_code IN ('unit_missing', 'unit_incomparable', 'context_unstated') THEN 'no-verdict' WHEN reason_code IN ('same_value', 'unit_diff_resolved') THEN 'corroborate'
        WHEN reason_code = 'value_conflict' THEN 'contradict' ELSE 'reconcilable' END AS verdict FROM coded)"""


def stated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized facts, as a table: every later step reads them several times."""
    return written(normalize_facts(sql(spark, sf_dir, _WRITTEN, "orders")), "facts")


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(find_candidates(stated_facts(spark, sf_dir)))


@query(
    _READ
    + """ SELECT id AS fact_id, 'CIN:L00001MH1995PLC' || lpad(CAST(c AS VARCHAR), 6, '0') AS subject_key, CASE WHEN canonical IS NOT NULL THEN CAST(base AS BIGINT) END AS base_value, canonical AS unit_canonical,
        CASE WHEN canonical IS NOT NULL THEN 'currency' END AS unit_family, CASE WHEN resolved THEN fy END AS fiscal_year, CASE WHEN resolved THEN sub END AS sub_period, scope, vintage,
        CAST(confidence AS DOUBLE) AS confidence FROM r"""
)
def normalized_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stated_facts(spark, sf_dir)
    period = F.col("signature.period")
    return f.select("fact_id", "subject_key", F.round("value_num").cast("long").alias("base_value"), "unit_canonical", "unit_family", period["fiscal_year"].alias("fiscal_year"), period["sub_period"].alias("sub_period"), "signature.scope", "signature.vintage", "confidence")


@query(_READ + " SELECT canonical IS NULL AS capped, count(*) AS n, CAST(max(confidence) AS DOUBLE) AS most FROM r GROUP BY 1")
def unresolved_confidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stated_facts(spark, sf_dir)
    return f.groupBy(F.col("unit_canonical").isNull().alias("capped")).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("most"))


@query(_READ + " SELECT fact_a, fact_b, CAST(1 AS DOUBLE) AS score, 'strong_key' AS subject_match, 'exact' AS attribute_match FROM pairs")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_rows(find_candidates(stated_facts(spark, sf_dir))).select("fact_a", "fact_b", "score", "subject_match", "attribute_match")


@query(_READ + " SELECT fact_a, fact_b FROM pairs WHERE fya = 1998 AND oa = 1 OR fyb = 1998 AND ob = 1")
def candidate_pairs_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stated_facts(spark, sf_dir)
    new = facts.where("source_doc = 'publisher 1' and fact_id like 'f1_1998_%'").select("fact_id")
    return candidate_rows(find_candidates(facts, new_fact_ids=new)).select("fact_a", "fact_b")


def _list(names: tuple[str, ...], flags: tuple[str, ...], when: str) -> str:
    parts = ", ".join(f"CASE WHEN {flag} THEN '{name}' END" for name, flag in zip(names, flags))
    return f"CASE WHEN {when} THEN concat_ws(',', {parts}) ELSE '' END"


_DIFFERING = _list(("period", "scope", "vintage"), ("dp", "ds", "dv"), "verdict = 'reconcilable'")
_UNSTATED = _list(("period", "scope", "vintage"), ("up", "us", "uv"), "reason_code IN ('same_value', 'unit_diff_resolved', 'context_unstated')")


@query(
    _READ
    + f""" SELECT fact_a, fact_b, 'r_' || substr(sha256(fact_a || chr(31) || fact_b), 1, 12) AS relationship_id, verdict, reason_code, CAST(confidence AS DOUBLE) AS confidence,
        {_DIFFERING} AS differing, {_UNSTATED} AS unstated FROM judged"""
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged_pairs(spark, sf_dir)
    return j.select(F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), "relationship_id", "verdict", "reason_code", F.round("confidence", 4).alias("confidence"), F.array_join("differing_fields", ",").alias("differing"), F.array_join("unstated_fields", ",").alias("unstated"))


@query(_READ + " SELECT verdict, reason_code, count(*) AS n FROM judged GROUP BY ALL")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pairs(spark, sf_dir).groupBy("verdict", "reason_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    _READ
    + """, said AS (SELECT *, CASE oa WHEN 0 THEN 'FY' || fya ELSE CASE WHEN fya = 2000 THEN '1999-00' ELSE 'FY' || fya END END AS pa,
        CASE ob WHEN 1 THEN CASE WHEN fyb = 2000 THEN '1999-00' ELSE 'FY' || fyb END ELSE CASE WHEN c % 4 = 0 THEN 'Q4 FY' || fyb ELSE 'FY' || fyb END END AS pb FROM judged)
    SELECT fact_a, fact_b, CASE reason_code WHEN 'period_diff' THEN 'These cover different periods, ' || pa || ' against ' || pb || ', so both values can hold.'
        WHEN 'scope_diff' THEN 'One figure is ' || CASE WHEN oa = 1 THEN 'standalone' ELSE 'consolidated' END || ' and the other ' || CASE WHEN ob = 1 THEN 'standalone' ELSE 'consolidated' END || ', which is a different reporting boundary rather than a conflict.'
        WHEN 'vintage_revision' THEN 'Same period reported at different stages; the revised figure supersedes the earlier one, so this is a revision.' END AS reason
    FROM said WHERE reason_code IN ('period_diff', 'scope_diff', 'vintage_revision')"""
)
def reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged_pairs(spark, sf_dir).where(F.col("reason_code").isin("period_diff", "scope_diff", "vintage_revision"))
    return j.select(F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), reason_text().alias("reason"))


@query()
def all_reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every reason, with the values as written; floats' shares make them unfit for SQL."""
    return relationships(judged_pairs(spark, sf_dir)).select("relationship_id", "reason_code", "reason_text")


@query(
    _READ
    + """, agreed AS (SELECT * FROM judged WHERE verdict = 'contradict')
    SELECT fact_a, fact_b, CAST(confidence AS DOUBLE) AS confidence FROM agreed WHERE confidence > 0.75 OR ob = 2"""
)
def relationships_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_relationships(relationships(judged_pairs(spark, sf_dir)), "customers", verdict="contradict")
    return rows.where("confidence > 0.75 or fact_b like 'f2%'").select("fact_a", "fact_b", F.round("confidence", 4).alias("confidence"))


@query(_READ + " SELECT id AS fact_id FROM r WHERE c % 10 = 7 AND o = 1 AND fy BETWEEN 1997 AND 1998")
def facts_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stated_facts(spark, sf_dir)
    found = filter_facts(facts, "customers", subject="7 limited", attribute="TOTAL price", period="199_-98", doc="doc1")
    older = filter_facts(facts, "customers", subject="7 limited", attribute="TOTAL price", period="1996-97", doc="doc1")
    return found.unionByName(older).select("fact_id")


@query(_READ + " SELECT 'customers' AS collection_id, verdict, count(*) AS n FROM judged GROUP BY ALL")
def counts_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_verdict(relationships(judged_pairs(spark, sf_dir)))


@query(_READ + " SELECT fact_a, fact_b, 'publisher ' || oa AS source_a, 'publisher ' || ob AS source_b, ua AS unit_a, ub AS unit_b FROM judged WHERE verdict = 'corroborate'")
def relationship_inline_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stated_facts(spark, sf_dir)
    rows = relationships(judge(find_candidates(facts))).where("verdict = 'corroborate'")
    return with_facts(rows, facts).select("fact_a", "fact_b", *[F.col(f"inline_{s}.{c}").alias(f"{n}_{s}") for s in "ab" for n, c in (("source", "source_doc"), ("unit", "unit"))])


#: Filings that mention one or two company numbers and speak of 'the Company'.
_FILINGS = """SELECT 'n' || c_nationkey AS source_doc, 'f' || lpad(CAST(c_custkey AS STRING), 9, '0') AS fact_id, 1 AS page, CASE WHEN c_custkey % 4 = 0 THEN 'the Company' ELSE 'Party ' || (c_custkey % 5) || ' Ltd' END AS subject,
    CAST(NULL AS STRING) AS subject_key, 'revenue' AS attribute, '5' AS value_raw, '₹' AS unit, CASE WHEN c_custkey % 5 IN (1, 2) AND c_custkey % 4 <> 0 AND c_nationkey % 2 = 0 THEN 'CIN U12345DL2001PTC00000' || (c_custkey % 5) END AS evidence_span,
    c_custkey, c_nationkey FROM {customer}"""


@query(
    """
    WITH f AS (SELECT c_nationkey AS d, c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN
        CASE WHEN c_custkey % 5 IN (1, 2) AND c_nationkey % 2 = 0 THEN 'CIN:U12345DL2001PTC00000' || (c_custkey % 5) ELSE 'name:party ' || (c_custkey % 5) END END AS key FROM customer),
    n AS (SELECT d, key, count(*) AS n, min(k) AS seen FROM f WHERE key IS NOT NULL GROUP BY d, key),
    best AS (SELECT d, key, row_number() OVER (PARTITION BY d ORDER BY key LIKE 'CIN:%' DESC, n DESC, seen) AS r FROM n)
    SELECT 'n' || d AS source_doc, key AS dominant FROM best WHERE r = 1"""
)
def self_reference_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.facts import bind_self_references, resolve

    facts = resolve(completed(sql(spark, sf_dir, _FILINGS, "customer")))
    own = bind_self_references(facts).where("subject = 'the Company'").groupBy("source_doc").agg(F.min("subject_key").alias("bound"), F.max("subject_key").alias("other"))
    return dominant_entities(facts).join(own, "source_doc", "left").where("bound is null or (bound = dominant and other = dominant)").select("source_doc", "dominant")


def _identity() -> Column:
    return fact_id(F.lit("lines"), F.col("doc"), F.lit("quantity"), F.col("value"), F.col("quote"))


@query(
    """
    WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, 'f_' || substr(sha256('lines' || chr(31) || 'part ' || (l_partkey % 100) || chr(31) || 'quantity' || chr(31) || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || chr(31) || 'sold ' || (l_suppkey % 10) || ' times'), 1, 12) AS fact_id FROM lineitem)
    SELECT fact_id, min(k * 10 + n) AS first, count(*) - 1 AS repeats FROM f GROUP BY fact_id"""
)
def dedup_facts_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.facts import dedup_facts

    text = """SELECT l_orderkey * 10 + l_linenumber AS ord, 1 AS page, 'part ' || (l_partkey % 100) AS doc, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS value,
        '  sold ' || (l_suppkey % 10) || CASE WHEN l_linenumber % 2 = 0 THEN '\n' ELSE '   ' END || 'times ' AS quote FROM {lineitem}"""
    facts = sql(spark, sf_dir, text, "lineitem").withColumn("fact_id", _identity())
    return dedup_facts(facts).select("fact_id", F.col("ord").alias("first"), "repeats")
