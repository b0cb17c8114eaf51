"""Queries that write values, units, periods, names and contexts, and parse them back.

Each builds strings from the test tables; its SQL twin derives what parsing
must give from the same columns, without parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import context, entities, periods, units
from ..functions.similarity import text_similarity
from ..operators.facts import bind_strong_keys, completed, map_board_status
from ..operators.matching import weak_key_clusters
from ..operators.nearest import nearest
from .registry import query, sql, table


@query(
    """
    WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)
    SELECT k,
        CASE k % 8 WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN CAST(n AS DOUBLE)
            WHEN 2 THEN CAST((1 + n % 99) * 100000 + (n % 100) * 1000 + n % 1000 AS DOUBLE)
            WHEN 3 THEN CAST(-n AS DOUBLE) WHEN 4 THEN CAST(-n AS DOUBLE) WHEN 6 THEN CAST(n % 100 AS DOUBLE) + 0.5 END AS number,
        CAST(CASE k % 8 WHEN 3 THEN 0 WHEN 7 THEN 2 ELSE 0 END AS INT) AS decimals
    FROM o"""
)
def parse_number_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("n"))
    s = F.col("n").cast("string")
    indian = F.concat((1 + F.col("n") % 99).cast("string"), F.lit(","), F.lpad((F.col("n") % 100).cast("string"), 2, "0"), F.lit(","), F.lpad((F.col("n") % 1000).cast("string"), 3, "0"))
    kind = F.col("k") % 8
    written = (
        F.when(kind == 0, s)
        .when(kind == 1, F.format_number("n", 0))
        .when(kind == 2, indian)
        .when(kind == 3, F.concat(F.lit("("), s, F.lit(")")))
        .when(kind == 4, F.concat(F.lit("₹("), F.format_number("n", 0), F.lit(") Cr")))
        .when(kind == 5, F.concat(s, F.lit(" to "), s))
        .when(kind == 6, F.concat((F.col("n") % 100).cast("string"), F.lit(". 5")))
        .otherwise(F.lit("between .12 and 7"))
    )
    return o.select("k", units.parse_number(written).alias("number"), units.decimals_of(written).alias("decimals"))


_UNITS = (
    ("₹ Cr", "8,142", "currency", "INR", "1e7"),
    ("₹ lakh", "12", "currency", "INR", "1e5"),
    ("Rs. mn", "3", "currency", "INR", "1e6"),
    ("USD_billion", "640.3", "currency", "USD", "1e9"),
    ("USD bn", "640.3", "currency", "USD", "1e9"),
    ("percent", "6.5", "percent", "percent", "1"),
    ("bps", "50", "percentage_point", "percentage_point", "0.01"),
    ("percentage points", "1.5", "percentage_point", "percentage_point", "1"),
    ("x", "2.4", "ratio", "ratio", "1"),
    ("shipments", "740 million", "other", "shipments", "1e6"),
    ("count_million", "3", "other", "count_million", "1e6"),
    (None, "€ 3 bn", "currency", "EUR", "1e9"),
    (None, "740", None, None, None),
    ("applications", "5", "percentage_point", "percentage_point", "1"),
    ("£", "5k", "currency", "GBP", "1"),
    ("tonnes per hectare", "2", "other", "tonnes_per_hectare", "1"),
)


def _values(rows: tuple[tuple, ...]) -> str:
    def cell(x: object) -> str:
        return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join([str(k), *map(cell, row)]) + ")" for k, row in enumerate(rows))


@query(
    f"""
    SELECT l_orderkey, l_linenumber, family, canonical, CAST(scale AS DOUBLE) AS scale
    FROM lineitem JOIN (VALUES {_values(_UNITS)}) AS u(i, unit, value, family, canonical, scale)
    ON i = (l_orderkey + l_linenumber) % {len(_UNITS)}"""
)
def parse_unit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(k, *row[:2]) for k, row in enumerate(_UNITS)], "i int, unit string, value string")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_UNITS)).cast("int").alias("i"))
    parsed = lines.join(F.broadcast(known), "i").withColumn("u", units.parse_unit(F.col("unit"), F.col("value")))
    return parsed.select("l_orderkey", "l_linenumber", "u.family", "u.canonical", "u.scale")


_FY = "CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS INT)"
_FQ = "CAST(CASE WHEN month(o_orderdate) >= 4 THEN floor((month(o_orderdate) - 4) / 3) + 1 ELSE 4 END AS INT)"


@query(f"SELECT o_orderkey, {_FY} AS fiscal_year, {_FQ} AS fiscal_quarter FROM orders")
def fiscal_year_of_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    return o.select("o_orderkey", periods.fiscal_year_of(year, month).alias("fiscal_year"), periods.fiscal_quarter_of(month).alias("fiscal_quarter"))


#: Written periods of an order's date by its key, as Spark SQL over y, m, d, fy, fq.
_WRITTEN = """CASE k % 14
    WHEN 0 THEN 'FY' || fy WHEN 1 THEN (fy - 1) || '-' || lpad(CAST(fy % 100 AS STRING), 2, '0') WHEN 2 THEN 'Q' || fq || ' FY' || fy
    WHEN 3 THEN 'H' || (CASE WHEN fq <= 2 THEN 1 ELSE 2 END) || ' FY' || fy
    WHEN 4 THEN 'as at ' || date_format(t, 'MMMM') || ' ' || d || ', ' || y
    WHEN 5 THEN 'quarter ended ' || date_format(t, 'MMM') || ' ' || d || ', ' || y
    WHEN 6 THEN 'year ended 31 ' || date_format(t, 'MMMM') || ' ' || y
    WHEN 7 THEN date_format(t, 'MMM') || '-' || lpad(CAST(y % 100 AS STRING), 2, '0')
    WHEN 8 THEN 'CY ' || y WHEN 9 THEN 'in ' || y WHEN 10 THEN 'half year ended ' || date_format(t, 'MMMM') || ' ' || y
    WHEN 11 THEN 'second half of FY' || lpad(CAST(fy % 100 AS STRING), 2, '0') WHEN 12 THEN 'some time ago' END"""


@query(
    f"""
    WITH o AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, {_FY} AS fy, {_FQ} AS fq FROM orders),
    r AS (SELECT *, k % 14 AS v, (fy - 1) // 100 = fy // 100 AS in_century FROM o)
    SELECT k,
        CASE WHEN v IN (0, 6) THEN 'FY' WHEN v = 1 AND in_century THEN 'FY' WHEN v IN (2, 5) THEN 'Q' WHEN v IN (3, 10, 11) THEN 'H' WHEN v = 4 THEN 'point_in_time'
            WHEN v = 7 THEN 'month' WHEN v IN (8, 9) THEN 'CY' END AS period_type,
        CAST(CASE WHEN v IN (0, 2, 3, 4, 5, 6, 10) THEN fy WHEN v = 1 AND in_century THEN fy
            WHEN v = 7 THEN 2000 + y % 100 + CASE WHEN m >= 4 THEN 1 ELSE 0 END WHEN v IN (8, 9) THEN y WHEN v = 11 THEN 2000 + fy % 100 END AS INT) AS fiscal_year,
        CASE WHEN v IN (2, 5) THEN 'Q' || fq WHEN v IN (3, 10) THEN CASE WHEN fq <= 2 THEN 'H1' ELSE 'H2' END WHEN v IN (4, 7) THEN 'M' || lpad(CAST(m AS VARCHAR), 2, '0')
            WHEN v = 11 THEN 'H2' END AS sub_period
    FROM r"""
)
def parse_period_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS t, year(o_orderdate) AS y, day(o_orderdate) AS d, {_FY} AS fy, {_FQ} AS fq FROM {{orders}})
        SELECT k, {_WRITTEN} AS written FROM o"""
    parsed = sql(spark, sf_dir, text, "orders").withColumn("p", periods.parse_period(F.col("written")))
    return parsed.select("k", "p.period_type", "p.fiscal_year", "p.sub_period")


@query(
    f"""
    WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, {_FY} AS fy, {_FQ} AS fq, k % 4 AS v FROM orders),
    s AS (SELECT *, CASE v WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN fq <= 2 THEN 1 ELSE 7 END ELSE 3 * fq - 2 END AS lo,
        CASE v WHEN 0 THEN 12 WHEN 1 THEN CASE WHEN fq <= 2 THEN 6 ELSE 12 END ELSE 3 * fq END AS hi FROM o WHERE v <> 3)
    SELECT a.k AS outer_key, b.k AS inner_key FROM s a JOIN s b ON a.c = b.c AND a.fy = b.fy
    WHERE a.lo <= b.lo AND b.hi <= a.hi AND (a.lo <> b.lo OR a.hi <> b.hi)
    UNION ALL SELECT a.o_orderkey, b.o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND year(a.o_orderdate) = year(b.o_orderdate)
    WHERE a.o_orderkey <> b.o_orderkey AND a.o_orderkey % 4 = 3 AND b.o_orderkey % 4 = 3"""
)
def period_contains_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, year(o_orderdate) AS y, {_FY} AS fy, {_FQ} AS fq FROM {{orders}})
        SELECT c, k, CASE k % 4 WHEN 0 THEN 'FY' || fy WHEN 1 THEN 'H' || (CASE WHEN fq <= 2 THEN 1 ELSE 2 END) || ' FY' || fy WHEN 2 THEN 'Q' || fq || ' FY' || fy ELSE 'CY ' || y END AS written FROM o"""
    p = sql(spark, sf_dir, text, "orders").withColumn("p", periods.parse_period(F.col("written")))
    # the year is part of the join key, so candidates are a customer's periods of one year
    a, b = (p.select("c", F.col("p.fiscal_year").alias("fy"), F.col("k").alias(f"{s}_key"), F.col("p").alias(s)) for s in ("outer", "inner"))
    return a.join(b, ["c", "fy"]).where((F.col("outer_key") != F.col("inner_key")) & periods.contains(F.col("outer"), F.col("inner"))).select("outer_key", "inner_key")


_FILLERS = "('the', 'a', 'an', 'of', 'for', 'in', 'on', 'at', 'to', 'as', 'per', 'and')"


@query(
    f"""
    WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' (at the ' || p_type || ')' WHEN 1 THEN 'GDP, at Market-Prices of ' || p_brand WHEN 2 THEN ' of the ' ELSE '6.5 % ' || p_type END AS t FROM part),
    w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(trim(t)), '[^a-z0-9%]+'), lambda x: x <> '') AS all_words FROM p)
    SELECT p_partkey, nullif(array_to_string(CASE WHEN len(list_filter(all_words, lambda x: x NOT IN {_FILLERS})) > 0 THEN list_filter(all_words, lambda x: x NOT IN {_FILLERS}) ELSE all_words END, '_'), '') AS token FROM w"""
)
def canonical_token_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' (at the ' || p_type || ')' WHEN 1 THEN 'GDP, at Market-Prices of ' || p_brand WHEN 2 THEN ' of the ' ELSE '6.5 % ' || p_type END AS t FROM {part}"""
    return sql(spark, sf_dir, text, "part").select("p_partkey", context.canonical_token(F.col("t")).alias("token"))


_CONTEXTS = (
    ("Consolidated", "consolidated", "First Advance Estimate", "advance_estimate"),
    ("unconsolidated figures", "standalone", "provisional", "provisional"),
    ("Stand-Alone", "standalone", "SRE", "revised"),
    ("the Group and its parts", "group_its_parts", "unaudited", "final"),
    ("", None, "outlook for the year", "projection"),
    (None, None, "restated", "restated"),
    ("non-consolidated", "standalone", "  ", None),
    ("Segment: retail", "segment_retail", "first advance, revised", "advance_estimate"),
)


@query(
    f"""
    SELECT o_orderkey, scope, vintage, CAST(CASE vintage WHEN 'advance_estimate' THEN 0 WHEN 'provisional' THEN 1 WHEN 'revised' THEN 2 WHEN 'final' THEN 3 END AS INT) AS vintage_rank
    FROM orders JOIN (VALUES {_values(_CONTEXTS)}) AS c(i, s, scope, v, vintage) ON i = o_orderkey % {len(_CONTEXTS)}"""
)
def scope_vintage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(k, row[0], row[2]) for k, row in enumerate(_CONTEXTS)], "i int, s string, v string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(_CONTEXTS)).cast("int").alias("i")).join(F.broadcast(known), "i")
    vintage = context.normalize_vintage(F.col("v"))
    return o.select("o_orderkey", context.normalize_scope(F.col("s")).alias("scope"), vintage.alias("vintage"), context.vintage_rank(vintage).alias("vintage_rank"))


_BASES = (
    ("real", "real", None, None),
    ("constant_prices", "real", None, None),
    ("nominal", "nominal", None, None),
    ("GDP at market prices", None, "gdp_market_price", None),
    ("GDP", None, "gdp", None),
    ("real GVA", "real", "gva", None),
    ("seasonally-adjusted GDP", None, "gdp", "seasonally_adjusted"),
    ("not seasonally adjusted", None, None, "seasonally_adjusted"),
    ("IFRS 16", None, None, None),
    ("management accounts", None, None, None),
)


@query(
    f"""
    WITH b AS (SELECT * FROM (VALUES {_values(_BASES)}) AS b(i, t, p, a, j)),
    x AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT s, n, l.t AS left_basis, r.t AS right_basis,
        CASE WHEN l.i = r.i THEN FALSE WHEN coalesce(l.p, l.a, l.j) IS NULL OR coalesce(r.p, r.a, r.j) IS NULL THEN TRUE
            ELSE coalesce(l.p <> r.p, FALSE) OR coalesce(l.a <> r.a, FALSE) OR coalesce(l.j <> r.j, FALSE) END AS conflicts
    FROM x JOIN b l ON l.i = s % {len(_BASES)} JOIN b r ON r.i = (s // {len(_BASES)}) % {len(_BASES)}"""
)
def basis_conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(k, row[0]) for k, row in enumerate(_BASES)], "i long, t string")
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    left, right = (F.broadcast(known.select(F.col("i").alias(f"{k}_i"), F.col("t").alias(f"{k}_basis"))) for k in ("left", "right"))
    x = x.join(left, F.col("left_i") == F.col("s") % len(_BASES)).join(right, F.col("right_i") == F.floor(F.col("s") / len(_BASES)) % len(_BASES))
    tokens = [context.normalize_basis(F.col(f"{k}_basis")) for k in ("left", "right")]
    return x.select("s", "n", "left_basis", "right_basis", context.basis_conflict(*tokens).alias("conflicts"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(replace(c_name, '#', ' ')) WHEN 1 THEN lower(replace(c_name, '#', ' ')) WHEN 2 THEN 's barua' || c_custkey ELSE '' END AS name,
        c_custkey % 4 = 3 AS is_self FROM customer"""
)
def normalize_name_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' Pvt. Ltd.' WHEN 1 THEN 'Mr. ' || c_name || '  HOLDINGS, Group'
        WHEN 2 THEN 'Shri Dr. S. Barua' || c_custkey ELSE 'Ltd. Company' END AS name, CASE c_custkey % 4 WHEN 3 THEN ' The  Company.' ELSE c_name END AS subject FROM {customer}"""
    c = sql(spark, sf_dir, text, "customer")
    return c.select("c_custkey", entities.normalize_name(F.col("name")).alias("name"), entities.is_self_reference(F.col("subject")).alias("is_self"))


@query("SELECT s_suppkey, s_suppkey || ' mg rd nr sec ' || (s_suppkey % 9) || ' ' || lower(n_name) AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def normalize_address_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT s_suppkey, s_suppkey || ', M.G. Road, near  Sector-' || (s_suppkey % 9) || ', ' || n_name AS a FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"
    s = sql(spark, sf_dir, text, "supplier", "nation")
    return s.select("s_suppkey", F.regexp_replace(entities.normalize_address(F.col("a")), " m g ", " mg ").alias("address"))


@query(
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'DIN:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN 'CIN:L12345MH1995PLC' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')
        WHEN 2 THEN 'LEI:' || c_custkey WHEN 3 THEN 'name:party ' || c_custkey WHEN 4 THEN 'name:' || lower(replace(c_name, '#', ' ')) END AS subject_key,
        CASE c_custkey % 6 WHEN 0 THEN 'person' WHEN 1 THEN 'organisation' END AS kind FROM customer"""
)
def subject_key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT c_custkey, CASE c_custkey % 6 WHEN 5 THEN 'Ltd' ELSE c_name || ' Limited' END AS subject,
        CASE c_custkey % 6 WHEN 2 THEN ' LEI:' || c_custkey || ' ' WHEN 3 THEN 'Party ' || c_custkey || ' Inc.' WHEN 1 THEN 'some: scheme' END AS stated,
        CASE c_custkey % 6 WHEN 0 THEN 'holds DIN : ' || lpad(CAST(c_custkey AS STRING), 8, '0') || ' since' WHEN 1 THEN 'cin l12345mh1995plc' || lpad(CAST(c_custkey AS STRING), 6, '0') || '.' END AS evidence FROM {customer}"""
    key = entities.resolve_subject_key(F.col("subject"), F.col("stated"), F.col("evidence"))
    return sql(spark, sf_dir, text, "customer").select("c_custkey", key.alias("subject_key"), entities.entity_kind(key).alias("kind"))


#: Facts on customers' directors: each nation's filing states numbers for names; every seventh name gets two.
_DIRECTORS = """SELECT c_custkey AS k, CAST(c_nationkey AS STRING) AS source_doc, 'f' || c_custkey AS fact_id, 1 AS page, 'Person ' || (c_custkey % 40) AS subject,
    'name:person ' || (c_custkey % 40) AS subject_key, CASE WHEN c_custkey % 3 = 0 THEN 'director_identification_number' ELSE 'role' END AS attribute,
    CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey % 40 + CASE WHEN c_custkey % 40 = 7 AND c_custkey % 2 = 0 THEN 500 ELSE 0 END AS STRING), 8, '0') ELSE 'Chair' END AS value_raw,
    CAST(NULL AS STRING) AS evidence_span FROM {customer}"""


@query(
    """
    WITH f AS (SELECT c_custkey AS k, c_nationkey AS d, c_custkey % 40 AS p, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 40 + CASE WHEN c_custkey % 40 = 7 AND c_custkey % 2 = 0 THEN 500 ELSE 0 END END AS n FROM customer),
    one AS (SELECT d, p, min(n) AS n FROM f WHERE n IS NOT NULL GROUP BY d, p HAVING count(DISTINCT n) = 1)
    SELECT k, CASE WHEN one.n IS NULL THEN 'name:person ' || f.p ELSE 'DIN:' || lpad(CAST(one.n AS VARCHAR), 8, '0') END AS subject_key
    FROM f LEFT JOIN one USING (d, p)"""
)
def bind_stated_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_strong_keys(completed(sql(spark, sf_dir, _DIRECTORS, "customer"))).select("k", "subject_key")


@query(
    """
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 4 THEN 'board_status' ELSE a END AS attribute,
        CASE WHEN s_suppkey % 2 = 0 THEN CASE s_suppkey % 5 WHEN 0 THEN 'resigned' WHEN 1 THEN 'active' WHEN 2 THEN 'resigned' WHEN 3 THEN 'active' END END AS category,
        CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 4 THEN a END AS attribute_raw
    FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'date_of_resignation' WHEN 1 THEN 'designation' WHEN 2 THEN 'stepped-down on' WHEN 3 THEN 'board_position' ELSE 'remuneration' END AS a FROM supplier)"""
)
def board_status_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'DIN:00000001' ELSE 'name:x' END AS subject_key,
        CASE s_suppkey % 5 WHEN 0 THEN 'date_of_resignation' WHEN 1 THEN 'designation' WHEN 2 THEN 'stepped-down on' WHEN 3 THEN 'board_position' ELSE 'remuneration' END AS attribute FROM {supplier}"""
    facts = completed(sql(spark, sf_dir, text, "supplier"))
    return map_board_status(map_board_status(facts)).select("s_suppkey", "attribute", "category", "attribute_raw")


@query(
    """
    WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey % 5 AS m FROM orders),
    p AS (SELECT *, v + CASE m WHEN 0 THEN 0 WHEN 1 THEN floor(v * 0.004) WHEN 2 THEN floor(v * 0.006) WHEN 3 THEN 1 ELSE 2 END AS w FROM o)
    SELECT k, abs(v - w) <= greatest(0.005 * greatest(v, w), 1.0) + 1e-12 AS agree, abs(v - w) <= 0.1 AS agree_percent FROM p"""
)
def value_agreement_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey % 5 AS m FROM {orders})
        SELECT k, CAST(v AS DOUBLE) AS a, CAST(v + CASE m WHEN 0 THEN 0 WHEN 1 THEN floor(v * 0.004D) WHEN 2 THEN floor(v * 0.006D) WHEN 3 THEN 1 ELSE 2 END AS DOUBLE) AS b FROM o"""
    p = sql(spark, sf_dir, text, "orders")
    a, b, zero = F.col("a"), F.col("b"), F.lit(0)
    return p.select("k", units.values_agree(a, b, F.lit("currency"), zero).alias("agree"), units.values_agree(a, b, F.lit("percent"), zero).alias("agree_percent"))


@query(
    """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS other_id, round(greatest(0.0, least(1.0, coalesce(list_cosine_similarity(q.v, e.v), 0.0))), 6) AS similarity
        FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, other_id) AS rank FROM s)
    SELECT query_id, other_id, similarity, rank FROM r WHERE rank <= 5"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of query vectors, those whose id 100 divides, against all vectors; the best five each."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return nearest(e, e.where("id % 100 = 0"), 5)


@query()
def hash_embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every two part names that share a word; each pair of texts is scored once."""
    types = table(spark, sf_dir, "part").select(F.col("p_name").alias("t")).distinct()
    words = types.select("t", F.explode(F.split(F.lower("t"), "[^a-z0-9]+")).alias("w"))
    a, b = (words.select("w", F.col("t").alias(s)) for s in ("a", "b"))
    pairs = a.join(b, "w").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(text_similarity("a", "b"), 9).alias("similarity"))


@query()
def weak_key_clusters_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clusters of part names' first two words, as names of one collection per brand."""
    name = F.lower(F.array_join(F.slice(F.split("p_name", " "), 1, 2), " "))
    keys = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("collection_id"), name.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.lpad(F.min("p_partkey").cast("string"), 12, "0").alias("seen"))
    return weak_key_clusters(keys.withColumn("text", F.col("key")))
