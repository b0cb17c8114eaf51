"""Queries on pages and model replies: grounding, gates, payloads, page selections, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import collapsed
from ..functions.units import has_digit, numeric_claim
from ..operators import adjudication, extraction, grounding
from ..operators.evaluation import greedy_matching, metrics, outcome
from ..session import written
from ..sources.pages import cited_pages, page_ranges
from ..streaming.incremental import ingest_report
from .reconcile import stated_facts
from .registry import query, sql, table


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''")
def verbatim_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated quotes of ``benchmark`` against all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(_benchmark(spark, sf_dir)), grounding.is_verbatim(F.col("quote"), F.col("text"))).select("doc_id", "item_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(replace(b.text, ' ', '  '), '\\s+', ' ', 'g')))")
def relaxed_verbatim_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quotes with other white space, which doesn't count here."""
    docs = table(spark, sf_dir, "documents").select("doc_id", collapsed(F.col("text")).alias("text"))
    quotes = _benchmark(spark, sf_dir).withColumn("quote", collapsed(F.replace("quote", F.lit(" "), F.lit("  "))))
    return docs.join(F.broadcast(quotes), grounding.is_verbatim(F.col("quote"), F.col("text"))).select("doc_id", "item_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))")
def normalized_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes in capitals and odd spaces, found by folding both sides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", grounding.normalize_text("text").alias("folded"))
    shouted = F.replace(F.upper("quote"), F.lit(" "), F.lit("   "))
    quotes = _benchmark(spark, sf_dir).select("item_id", grounding.normalize_text(shouted).alias("needle"))
    return docs.join(F.broadcast(quotes), F.contains("folded", "needle")).select("doc_id", "item_id")


@query()
def fuzzy_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, whole, as a quote with its second word left out, sought in its conversation."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), "text")
    words = F.split("text", " ")
    bent = F.array_join(F.concat(F.slice(words, 1, 1), F.slice(words, 3, F.greatest(F.size(words), F.lit(1)))), " ")
    quotes = turns.select("doc_id", bent.alias("quote"), "page_index")
    found = grounding.ground_quotes(quotes, turns.select("doc_id", "page_index", "text"))
    return found.select("doc_id", "page_index", "found_on", "grounding_method", F.round("score", 6).alias("score"), "matched_text")


_BOXES = "l_orderkey AS k, CAST(l_linenumber // 3 AS INT) AS line, l_quantity AS x0, l_linenumber * 10.0 AS y0, l_quantity + 5 AS x1, l_linenumber * 10.0 + 8 AS y1"


@query(f"SELECT k, line, min(x0) AS x0, CAST(min(y0) AS DOUBLE) AS y0, max(x1) AS x1, CAST(max(y1) AS DOUBLE) AS y1 FROM (SELECT {_BOXES} FROM lineitem) GROUP BY k, line")
def rect_union_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.lit(0).alias("block"),
        F.floor(F.col("l_linenumber") / 3).cast("int").alias("line"),
        F.col("l_linenumber").alias("position"),
        F.col("l_quantity").alias("x0"),
        (F.col("l_linenumber") * 10.0).cast("double").alias("y0"),
        (F.col("l_quantity") + 5).alias("x1"),
        (F.col("l_linenumber") * 10.0 + 8).cast("double").alias("y1"),
    )
    return grounding.line_rects(words, ["k"]).select("k", "line", "x0", "y0", "x1", "y1")


@query(
    """SELECT event_id, event_type AS subject, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS value_raw, CAST(CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.25 END AS DOUBLE) AS confidence,
        CASE WHEN event_id % 2 = 0 THEN 'FY24' END AS period FROM events WHERE event_id % 5 <> 4"""
)
def coerce_facts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of event rows: fenced, wrapped in prose or a key, nested or flat, some without a quote."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    confidence = F.when(F.col("event_id") % 4 == 0, '"high"').when(F.col("event_id") % 4 == 1, "7").when(F.col("event_id") % 4 == 2, "-1").otherwise("0.25")
    context = F.when(F.col("event_id") % 4 == 0, ', "context": {"period": " FY24 "}').when(F.col("event_id") % 4 == 2, ', "period": "FY24"').otherwise("")
    quote = F.when(F.col("event_id") % 5 == 4, " ").otherwise("says ] so")
    fact = F.concat(F.lit('{"subject": " '), F.col("event_type"), F.lit('", "attribute": "k", "value_raw": '), k, F.lit(', "evidence_span": "'), quote, F.lit('", "confidence": '), confidence, context, F.lit("}"))
    kind = F.col("event_id") % 3
    reply = F.when(kind == 0, F.concat(F.lit("```json\n["), fact, F.lit("]\n```"))).when(kind == 1, F.concat(F.lit("Here you are: ["), fact, F.lit("] as asked."))).otherwise(F.concat(F.lit('{"results": ['), fact, F.lit(", 5]}")))
    parsed = e.select("event_id", extraction.parse_payload(extraction.strip_code_fences(reply)).alias("p"))
    return parsed.select("event_id", F.explode("p.facts").alias("f")).select("event_id", "f.subject", "f.value_raw", "f.confidence", "f.period")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1")
def drop_valueless(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    facts = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(kind == 3, "  ").otherwise("percent").alias("unit"), F.when(kind.isin(1, 3), "strong").otherwise(F.col("o_totalprice").cast("string")).alias("value_raw")
    )
    return facts.where(~numeric_claim(F.col("unit")) | has_digit(F.col("value_raw"))).select("o_orderkey")


_SPEC = "CAST(s_suppkey % 7 + 3 AS {0}) || '-' || CAST(s_suppkey % 7 + 1 AS {0}) || ', ' || CAST(s_suppkey % 11 + 1 AS {0}) || ';'"


@query(
    """SELECT s_suppkey, page FROM (SELECT s_suppkey, unnest([s_suppkey % 7 + 1, s_suppkey % 7 + 2, s_suppkey % 7 + 3, s_suppkey % 11 + 1]) AS p, CAST(p AS INT) AS page FROM supplier) GROUP BY ALL"""
)
def page_range_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = sql(spark, sf_dir, f"SELECT s_suppkey, {_SPEC.format('STRING')} AS spec FROM {{supplier}}", "supplier")
    return spec.select("s_suppkey", F.explode(page_ranges(F.col("spec"))).alias("page"))


@query("SELECT DISTINCT s_suppkey, CAST(greatest(1, unnest([p - 1, p, p + 1, q - 1, q, q + 1])) AS INT) AS page FROM (SELECT s_suppkey, s_suppkey % 5 + 1 AS p, s_suppkey % 8 + 4 AS q FROM supplier)")
def cited_page_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    pages = F.array((F.col("s_suppkey") % 5 + 1).cast("int"), (F.col("s_suppkey") % 8 + 4).cast("int"))
    return s.select("s_suppkey", F.explode(cited_pages(pages, F.lit(1))).alias("page"))


@query(
    """SELECT CAST(doc_id % 20 AS VARCHAR) AS doc_id, count(*) AS pages_processed, count(*) FILTER (doc_id % 9 = 0) AS pages_failed, CAST(sum(n_chars % 5) AS BIGINT) AS proposed, CAST(sum(n_chars % 3) AS BIGINT) AS unverbatim,
        count(*) FILTER (n_chars % 4 IN (0, 1)) AS grounded, count(*) FILTER (n_chars % 4 = 2) AS dropped_ungrounded, count(*) FILTER (n_chars % 4 = 3) AS duplicates, count(*) FILTER (n_chars % 4 = 1) AS unresolved_units
        FROM documents GROUP BY 1"""
)
def ingest_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).cast("string").alias("doc_id"), F.col("doc_id").alias("page"), "n_chars")
    pages = d.select("doc_id", F.when(F.col("page") % 9 == 0, "failed").alias("error"), (F.col("n_chars") % 5).alias("proposed"), (F.col("n_chars") % 3).alias("unverbatim"))
    kind = F.col("n_chars") % 4
    facts = d.select("doc_id", F.when(kind == 3, "duplicate").when(kind == 2, "ungrounded").otherwise("stored").alias("outcome"), (kind == 0).alias("resolved"))
    return ingest_report(pages, facts).drop("grounding_rate")


@query(
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS c, CAST(o_orderkey % 130 AS DOUBLE) / 100 AS p, o_orderkey % 4 AS m FROM orders)
    SELECT k, CASE WHEN m = 1 OR m = 3 THEN 'rules' ELSE 'because it is' END AS reason_text, round(CASE WHEN m IN (1, 3) THEN c ELSE least(c, least(1.0, p)) END, 6) AS confidence, m NOT IN (1, 3) AS adjudicated FROM o"""
)
def adjudication_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that explain, that argue for another verdict (1), and that can't be read (3)."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    p = F.format_string("%.2f", (key % 130) / 100.0)
    verdict = F.when(kind == 1, "contradict").when(kind == 0, "corroborate").otherwise("")
    reply = F.when(kind == 3, "no idea").otherwise(F.concat(F.lit('So: [{"verdict": "'), verdict, F.lit('", "reason_text": " because\\nit   is ", "confidence": '), p, F.lit("}]")))
    rows = table(spark, sf_dir, "orders").select(key.alias("k"), F.lit("corroborate").alias("verdict"), F.lit("rules").alias("reason_text"), ((key % 100) / 100.0).cast("double").alias("confidence"), adjudication.parse_adjudication(extraction.strip_code_fences(reply)).alias("reply"))
    return adjudication.apply_adjudication(rows).select("k", "reason_text", F.round("confidence", 6).alias("confidence"), "adjudicated")


#: Edges within each supplier's lines, so that keys and matches grow with the table.
_EDGES = "SELECT l_suppkey AS b, l_suppkey * 1000 + l_orderkey % 97 AS label_ord, l_suppkey * 1000 + l_partkey % 89 AS fact_ord, CAST(max(l_linenumber * 7 + l_quantity) AS DOUBLE) AS similarity FROM {0} GROUP BY 1, 2, 3"


@query(
    f"""
    WITH RECURSIVE e AS (SELECT row_number() OVER (PARTITION BY b ORDER BY similarity DESC, label_ord, fact_ord) AS n, * FROM ({_EDGES.format("lineitem")})),
    g AS (SELECT 1 AS n, b, [e.label_ord] AS ls, [e.fact_ord] AS fs, TRUE AS taken, label_ord, fact_ord, similarity FROM e WHERE n = 1
        UNION ALL SELECT e.n, e.b, CASE WHEN t THEN list_append(g.ls, e.label_ord) ELSE g.ls END, CASE WHEN t THEN list_append(g.fs, e.fact_ord) ELSE g.fs END, t, e.label_ord, e.fact_ord, e.similarity
        FROM g JOIN (SELECT * FROM e) e ON e.n = g.n + 1 AND e.b = g.b, LATERAL (SELECT NOT list_contains(g.ls, e.label_ord) AND NOT list_contains(g.fs, e.fact_ord) AS t))
    SELECT label_ord, fact_ord, similarity FROM g WHERE taken"""
)
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_matching(sql(spark, sf_dir, _EDGES.format("{lineitem}"), "lineitem"))


def _labels(spark: SparkSession, sf_dir: str, facts: DataFrame) -> DataFrame:
    """Labels on all customers' facts of every year by publisher 0: right ones, wrong values, and attributes without facts."""
    customers = sql(spark, sf_dir, "SELECT c_custkey AS c FROM {customer}", "customer")
    own = facts.where("doc_id = 'doc0'").select(F.regexp_extract("subject", r"(\d+)", 1).cast("long").alias("c"), F.col("signature.period.fiscal_year").alias("fy"), "value_raw", F.col("page").alias("p"))
    rows = customers.join(own, "c", "left")
    text = F.col("c").cast("string")
    wrong = F.when(F.col("c") % 20 == 0, F.concat(F.col("value_raw"), F.lit("0")))
    return rows.select(
        F.xxhash64("c", "fy").alias("label_ord"),
        F.concat(F.lit("doc0 customer "), text, F.lit(".pdf")).alias("document"),
        F.concat(F.lit("Customer "), text).alias("subject"),
        F.when(F.col("c") % 3 == 0, "headcount").otherwise("total_price").alias("attribute"),
        F.coalesce(wrong, "value_raw", F.lit("1")).alias("value"),
        F.lit("₹").alias("unit"),
        F.concat(F.lit("FY"), F.coalesce("fy", F.lit(1998)).cast("string")).alias("period"),
        F.array("p").alias("pages"),
    )


@query()
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of metrics of the labels above against all publishers' facts, each customer's a document of its own."""
    facts = stated_facts(spark, sf_dir)
    own = F.concat("doc_id", F.lit(" customer "), F.regexp_extract("subject", r"(\d+)", 1))
    scored = written(facts.withColumns({"fact_ord": F.xxhash64("fact_id"), "source_doc": own}), "facts")
    labels = written(_labels(spark, sf_dir, facts), "labels")
    matches, _, spurious = outcome(labels, scored)
    return metrics(labels, matches, spurious)
