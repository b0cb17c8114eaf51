"""Parsing rules, one table of cases each."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import context, entities, identity, periods, presentation, similarity, units


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_numbers(spark):
    cases = {
        "81,415.38": 81415.38, "12,34,567": 1234567.0, "1,234,567": 1234567.0, "(1,234)": -1234.0, "(452) Cr": -452.0, "(1,234.5) mn": -1234.5, "(6.3%)": -6.3,
        "₹(452) Cr": -452.0, "5 to 6": None, "no digits here": None, "": None, "−5": -5.0, "12. 5": 12.5, "１２": 12.0, "about 7 units": 7.0, "-(452)": 452.0,
    }
    assert column(spark, [*cases, None], units.parse_number) == [*cases.values(), None]
    assert column(spark, ["1.250", "7", "", None], units.decimals_of) == [3, 0, None, None]


def test_units(spark):
    cases = {
        ("₹ Cr", "8,142"): ("currency", "INR", 1e7), ("₹ lakh", "1"): ("currency", "INR", 1e5), ("Rs. mn", "1"): ("currency", "INR", 1e6), ("₹ bn", "1"): ("currency", "INR", 1e9),
        (None, "740"): None, ("bps", "50"): ("percentage_point", "percentage_point", 0.01), ("percent", "6.5"): ("percent", "percent", 1.0), (None, "5 years."): ("currency", "INR", 1.0),
        (None, "₹8,142cr"): ("currency", "INR", 1.0), ("shipments", "3 million"): ("other", "shipments", 1e6), ("times", "2"): ("ratio", "ratio", 1.0),
        ("shipping days", "4"): ("percentage_point", "percentage_point", 1.0), (None, None): None,
    }
    rows = spark.createDataFrame([(k, *pair) for k, pair in enumerate(cases)], "k int, u string, v string")
    got = [r.x for r in rows.select("k", units.parse_unit(F.col("u"), F.col("v")).alias("x")).orderBy("k").collect()]
    assert [g and (g.family, g.canonical, g.scale) for g in got] == list(cases.values())


def test_periods(spark):
    cases = {
        "FY24": ("FY", 2024, None), "FY 2023-24": ("FY", 2024, None), "2023-24": ("FY", 2024, None), "FY2024/25": ("FY", 2025, None), "2021/22": ("FY", 2022, None),
        "Q4 FY24": ("Q", 2024, "Q4"), "H1 FY25": ("H", 2025, "H1"), "quarter ended December 31, 2023": ("Q", 2024, "Q3"), "as at 31st March 2024": ("point_in_time", 2024, "M03"),
        "year ended March 31, 2024": ("FY", 2024, None), "Mar-24": ("month", 2024, "M03"), "CY2022": ("CY", 2022, None), "2022": ("CY", 2022, None), "Q4 2024": ("Q", 2024, "Q4"),
        "fiscal 2024": ("CY", 2024, None), "1999-00": (None, None, None), "FY1999-00": ("FY", 1999, None), "recently": (None, None, None), "Apr–Dec 2024": ("month", 2025, "M12"),
        "half year ended September 2023": ("H", 2024, "H1"), " ": (None, None, None),
    }
    got = column(spark, list(cases), periods.parse_period)
    assert [(g.period_type, g.fiscal_year, g.sub_period) for g in got] == list(cases.values())
    assert got[0].raw == "FY24" and got[-1].raw is None and got[17].raw == "recently"


def test_containment_is_a_strict_order(spark):
    names = ["FY24", "Q4 FY24", "H1 FY24", "Q1 FY24", "H2 FY24", "as at March 31, 2024", "FY25", "2024", "nothing", "CY 2024"]
    p = spark.createDataFrame([(n,) for n in names], "n string").withColumn("p", periods.parse_period(F.col("n")))
    a, b = (p.select(F.col("n").alias(s), F.col("p").alias("p" + s)) for s in "ab")
    inside = {(r.a, r.b) for r in a.crossJoin(b).where(periods.contains(F.col("pa"), F.col("pb"))).collect()}
    year = {("FY24", x) for x in ("Q4 FY24", "H1 FY24", "Q1 FY24", "H2 FY24", "as at March 31, 2024")}
    assert inside - {("2024", "2024"), ("CY 2024", "CY 2024")} == year | {("H1 FY24", "Q1 FY24"), ("H2 FY24", "Q4 FY24"), ("Q4 FY24", "as at March 31, 2024"), ("H2 FY24", "as at March 31, 2024")}


def test_context_words(spark):
    assert column(spark, ["GDP (at market prices)", "GDP at market prices", "of the", "", None, "ΑΒΓ", "6.5 % rise"], context.canonical_token) == ["gdp_market_prices", "gdp_market_prices", "of_the", None, None, None, "6_5_%_rise"]
    assert column(spark, ["Unconsolidated", "CONSOLIDATED basis", "Stand-alone", "Segment A"], context.normalize_scope) == ["standalone", "consolidated", "standalone", "segment"]
    assert column(spark, ["First Advance Estimate", "actuals", "forecast", "PE", "restated", "unaudited"], context.normalize_vintage) == ["advance_estimate", "final", "projection", "provisional", "restated", "final"]
    pairs = {("real", "GDP_market_price"): False, ("real", "nominal"): True, ("odd", "other"): True, ("odd", "odd"): False, ("gdp", "gdp_market_price"): True, (None, "real"): True, (None, None): False, ("not_seasonally_adjusted", "seasonally_adjusted"): False}
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    assert [r.x for r in rows.select("k", context.basis_conflict(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()] == list(pairs.values())
    vintages = {("provisional", "revised"): "revised", ("final", "advance_estimate"): "final", ("projection", "final"): None, ("final", "final"): None}
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(vintages)], "k int, a string, b string")
    assert [r.x for r in rows.select("k", context.newer_vintage(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()] == list(vintages.values())


def test_entities(spark):
    names = {"Delhi Freight Limited": "delhi freight", "delhi freight ltd.": "delhi freight", "Mr. Dr. Café Noël": "café noël", "Ltd": "", "Group Holdings Co": "", "": "", None: "", "Shri": "", "Public Co Works": "public co works"}
    assert column(spark, list(names), entities.normalize_name) == list(names.values())
    assert column(spark, ["the Company", " Our  company.", "The Bank of X", None], entities.is_self_reference) == [True, True, False, False]
    assert column(spark, ["12, M.G. Road, Near Sector-5", None], entities.normalize_address) == ["12 m g rd nr sec 5", ""]
    rows = [("A Ltd", None, "DIN: 01173669"), ("A Ltd", "U12345DL2001PTC000001", None), ("A Ltd", "LEI:9", None), ("A Ltd", "B Inc", None), ("A Ltd", None, None), ("Ltd", " ", None), ("holder of din#00000001", "X:1", "cin l12345mh1995plc000001")]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, s string, t string, e string").select("k", entities.resolve_subject_key(F.col("s"), F.col("t"), F.col("e")).alias("x")).orderBy("k").collect()
    assert [r.x for r in got] == ["DIN:01173669", "CIN:U12345DL2001PTC000001", "LEI:9", "name:b", "name:a", None, "DIN:00000001"]
    claims = [("director_identification_number", "01173669", None), ("CIN", "l12345mh1995plc000001", None), ("role", "01173669", None), ("role", "x", "his DIN 00000002"), ("registration no", "12", None)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(claims)], "k int, a string, v string, e string").select("k", entities.identifier_stated_by(F.col("a"), F.col("v"), F.col("e")).alias("x")).orderBy("k").collect()
    assert [r.x for r in got] == ["DIN:01173669", "CIN:L12345MH1995PLC000001", None, "DIN:00000002", None]


@pytest.mark.parametrize(("a", "b", "family", "decimals", "agree"), [(1000, 1004, "currency", 0, True), (1000, 1010, "currency", 0, False), (6.0, 6.4, "other", 0, True), (6.0, 6.4, "other", 2, False), (6.4, 6.5, "percent", 1, True), (6.4, 6.8, "percent", 1, False), (None, 1, "other", 0, False), (5, 6, None, None, False)])
def test_tolerance_is_symmetric(spark, a, b, family, decimals, agree):
    rows = spark.createDataFrame([(a and float(a), b and float(b), family, decimals)], "a double, b double, f string, d int")
    x, y, f, d = (F.col(c) for c in "abfd")
    assert tuple(rows.select(units.values_agree(x, y, f, d), units.values_agree(y, x, f, d)).first()) == (agree, agree)


def test_ids(spark):
    r = spark.range(1).select(
        identity.relationship_id(F.lit("f_b"), F.lit("f_a")).alias("x"), identity.relationship_id(F.lit("f_a"), F.lit("f_b")).alias("y"), identity.fact_id(F.lit("c"), F.lit("d"), F.lit("a"), F.lit("v"), F.lit(" q  r\n")).alias("f")
    ).first()
    import hashlib

    assert r.x == r.y == "r_" + hashlib.sha256(b"f_a\x1ff_b").hexdigest()[:12]
    assert r.f == "f_" + hashlib.sha256("c\x1fd\x1fa\x1fv\x1fq r".encode()).hexdigest()[:12]


def test_embedding(spark):
    dense = spark.createDataFrame([("operating revenue",), ("revenue from operations",), ("",)], "t string").select(similarity.hash_embed("t").alias("v"))
    a, b, none = (r.v for r in dense.collect())
    assert len(a) == 512 and abs(sum(x * x for x in a) - 1) < 1e-9 and not any(none)
    want = sum(x * y for x, y in zip(a, b))
    assert similarity.text_cosine("operating revenue", "revenue from operations") == pytest.approx(max(0, want))
    row = spark.createDataFrame([(a, b, none, [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    got = row.select(similarity.cosine(F.col("a"), F.col("b")), similarity.cosine(F.col("a"), F.col("z")), similarity.cosine(F.col("a"), F.col("s")), similarity.cosine(F.col("a"), F.col("a"))).first()
    assert got[0] == pytest.approx(max(0, want)) and got[1] == got[2] == 0 and got[3] == pytest.approx(1)
    assert similarity.text_cosine("revenue from operations", "operating revenue") > 0.3 > similarity.text_cosine("headcount", "revenue from operations")


def test_presentation(spark):
    assert presentation.shown_value("28,367.97", "INR_million", True) == "₹28,367.97 million" and presentation.shown_value(None, "percent", True) == "—"
    assert column(spark, ["litigation_amount-due", "", None], presentation.format_attribute) == ["Litigation amount due", "—", "—"]
    assert column(spark, ["02-annual-report_2024", ""], presentation.format_document) == ["Annual report 2024", "Unknown document"]
    assert column(spark, ['<a href="x">&</a>'], presentation.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"]
