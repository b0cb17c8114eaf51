"""The engine on small sets of facts: decision table, matching, binding, store, grounding, evaluation, streaming."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import adjudication, evaluation, extraction, grounding
from factloom.operators.facts import dedup_facts, normalize_facts
from factloom.operators.matching import candidate_rows, find_candidates
from factloom.operators.verdicts import VERDICT_OF, judge, relationships
from factloom.sources import labels as label_files
from factloom.sources import pages as page_sources
from factloom.sources.store import SnapshotStore, embedded, upserted
from factloom.sources.views import NotFound, ReadApi
from factloom.functions import similarity
from factloom.functions.similarity import MODEL, hash_embed
from factloom.streaming.incremental import reconcile_batch, reconcile_stream

SCHEMA = (
    "collection_id string, doc_id string, fact_id string, source_doc string, page int, subject string, attribute string, value_raw string, unit string, context_period string, "
    "context_scope string, context_basis string, context_vintage string, category string, evidence_span string, confidence double, grounding_method string"
)


def fact(doc, value, unit=None, period="FY24", scope=None, basis=None, vintage=None, subject="Acme Ltd", attribute="revenue", category=None, evidence=None, page=1, n=0):
    name = f"{doc}-{subject}-{attribute}-{value}-{period}-{n}"
    return ("c", doc, name, doc, page, subject, attribute, value, unit, period, scope, basis, vintage, category, evidence, 0.9, "normalized")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


TABLE = {
    "unit_incomparable": (("5", "USD"), ("5", "percent")),
    "unit_missing": (("5", None), ("5", "₹")),
    "period_subset": (("5", "₹", "FY24"), ("2", "₹", "Q4 FY24")),
    "period_diff": (("5", "₹", "FY24"), ("2", "₹", "FY23")),
    "scope_diff": (("5", "₹", "FY24", "standalone"), ("9", "₹", "FY24", "consolidated")),
    "basis_diff": (("5", "₹", "FY24", None, "real"), ("9", "₹", "FY24", None, "nominal")),
    "vintage_revision": (("5", "₹", "FY24", None, None, "provisional"), ("9", "₹", "FY24", None, None, "revised")),
    "same_category": (("Active",), ("active",)),
    "category_conflict": (("active",), ("resigned",)),
    "unit_diff_resolved": (("8,142", "₹ Cr"), ("81,415.38", "₹ million")),
    "same_value": (("6.4", "percent"), ("6.5", "percent")),
    "context_unstated": (("5", "₹", "FY24", "consolidated"), ("9", "₹", "FY24")),
    "value_conflict": (("50", "₹"), ("90", "₹")),
}


def test_decision_table_in_both_orders(spark):
    rows = []
    for code, (a, b) in TABLE.items():
        for order, (x, y) in enumerate(((a, b), (b, a))):
            subject = f"{code.replace('_', ' ')} {order} works"
            rows += [fact("doc a", *x, subject=subject, evidence=f"CIN L00001MH1995PLC{len(rows):06d}"), fact("doc b", *y, subject=subject, evidence=f"CIN L00001MH1995PLC{len(rows):06d}")]
    judged = judge(find_candidates(normalize_facts(frame(spark, *rows))))
    got = {(r.subject, r.reason_code): r.verdict for r in judged.select("a.subject", "reason_code", "verdict").collect()}
    assert got == {(f"{code.replace('_', ' ')} {k} works", code): VERDICT_OF[code] for code in TABLE for k in (0, 1)}
    texts = {r.reason_code: r.reason_text for r in relationships(judged).collect()}
    assert "FY2024 covers Q4 FY2024" in texts["period_subset"] and "differ by 44.4%" in texts["value_conflict"] and "the revised figure supersedes" in texts["vintage_revision"]
    assert texts["category_conflict"].endswith("The same subject cannot be both.") and "its scope" in texts["context_unstated"]


def test_matching(spark):
    rows = [
        fact("a", "5", "₹"), fact("b", "5", "₹", subject="ACME Limited"), fact("b", "6", "₹", n=1), fact("c", "5", "₹", subject="Zebra Works"),
        fact("c", "5", "₹", attribute="total_revenue"), fact("d", "5", "₹", attribute="headcount"),
        fact("a", "x", subject="P", evidence="DIN 00000001"), fact("b", "x", subject="P", evidence="DIN 00000002"), fact("c", "x", subject="Q", evidence="DIN 00000001"),
    ]
    facts = normalize_facts(frame(spark, *rows)).persist()
    pairs = candidate_rows(find_candidates(facts)).collect()
    docs = {tuple(sorted((r.fact_a, r.fact_b))) for r in pairs}
    assert all(a.split("-")[0] != b.split("-")[0] for a, b in docs)
    strong = [r for r in pairs if r.subject_match == "strong_key"]
    assert [sorted((r.fact_a[0], r.fact_b[0])) for r in strong] == [["a", "c"]]
    assert not any("Zebra" in a + b or "headcount" in a + b for a, b in docs)
    assert any(r.attribute_match == "similar" for r in pairs) and all(r.score >= 0.5 for r in pairs)
    new = facts.where("source_doc = 'c'").select("fact_id")
    fresh = {tuple(sorted((r.fact_a, r.fact_b))) for r in candidate_rows(find_candidates(facts, new_fact_ids=new)).collect()}
    assert fresh == {p for p in docs if p[0].startswith("c-") or p[1].startswith("c-")}
    assert len(candidate_rows(find_candidates(facts, limit=2)).collect()) == 2


def test_collections_stay_apart(spark):
    facts = normalize_facts(frame(spark, fact("a", "5", "₹"), fact("b", "5", "₹")).withColumn("collection_id", F.col("doc_id")))
    assert find_candidates(facts).count() == 0


def test_bindings_and_idempotence(spark):
    rows = [
        fact("a", "5", "₹", subject="the Company", n=1), fact("a", "5", "₹", subject="Acme Ltd", n=2), fact("a", "7", "₹", subject="Other Co Works", n=3), fact("a", "7", "₹", subject="Acme Ltd", n=4),
        fact("b", "01173669", subject="Mr S Barua", attribute="din"), fact("b", "Chair", subject="S. Barua", attribute="designation"), fact("b", "May 2023", subject="S Barua", attribute="date_of_resignation"),
        fact("c", "00000001", subject="T Rao", attribute="din"), fact("c", "00000002", subject="T Rao", attribute="din"), fact("c", "x", subject="T. Rao", attribute="role"),
    ]
    once = normalize_facts(frame(spark, *rows))
    got = {r.fact_id: r for r in once.collect()}
    assert got["a-the Company-revenue-5-FY24-1"].subject_key == "name:acme"
    assert {r.subject_key for k, r in got.items() if k.startswith("b-")} == {"DIN:01173669"}
    assert got["c-T. Rao-role-x-FY24-0"].subject_key == "name:t rao"
    assert {(r.attribute, r.category) for k, r in got.items() if k.startswith("b-") and r.attribute == "board_status"} == {("board_status", "active"), ("board_status", "resigned")}
    again = {r.fact_id: r for r in normalize_facts(normalize_facts(once)).collect()}
    assert {k: (r.attribute, r.category, r.subject_key, r.confidence) for k, r in again.items()} == {k: (r.attribute, r.category, r.subject_key, r.confidence) for k, r in got.items()}


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([("x", 2, 1), ("x", 1, 2), ("y", 1, 1)], "fact_id string, page int, ord int")
    assert {(r.fact_id, r.page, r.repeats) for r in dedup_facts(rows).collect()} == {("x", 1, 1), ("y", 1, 0)}


def test_grounding(spark):
    pages = spark.createDataFrame([("d", 0, "Revenue was “high” in FY24.\nProfit fell."), ("d", 1, "Nothing here but profit fell."), ("d", 2, "the ﬁnal total of shipments grew strongly last year")], "doc_id string, page_index int, text string")
    quotes = [("d", "Profit fell.", 0), ("d", 'revenue was "HIGH" in  fy24', 0), ("d", "profit fell", 1), ("d", "final total of shipments grew strongly this year", 2), ("d", "quite another thing altogether", 0), ("d", "Revenue was", None)]
    got = {r.quote: r for r in grounding.ground_quotes(spark.createDataFrame(quotes, "doc_id string, quote string, page_index int"), pages).collect()}
    assert (got["Profit fell."].found_on, got["Profit fell."].grounding_method) == (0, "search_for")
    assert got['revenue was "HIGH" in  fy24'].grounding_method == "normalized" and got["profit fell"].found_on == 1
    near = got["final total of shipments grew strongly this year"]
    assert near.grounding_method == "fuzzy" and near.found_on == 2 and 0.85 <= near.score < 1 and "shipments" in near.matched_text
    assert got["quite another thing altogether"].grounding_method is None and got["Revenue was"].found_on == 0
    boxes = spark.createDataFrame([([(0.0, 0.0, 5.0, 10.0), (6.0, 1.0, 9.0, 9.0), (0.0, 20.0, 4.0, 30.0)],)], "r array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [tuple(x) for x in boxes.select(grounding.merge_visual_lines(F.col("r")).alias("m")).first().m] == [(0, 0, 9, 10), (0, 20, 4, 30)]


def test_payloads(spark):
    ok = {"subject": "S", "attribute": "a", "value_raw": 5, "evidence_span": "a ] [ b", "confidence": 3}
    replies = [json.dumps([ok]), "```json\n" + json.dumps({"facts": [ok, 1]}) + "\n```", "Sure: " + json.dumps([ok]) + " done", json.dumps(ok), '[{"subject": "S"', "", json.dumps([{**ok, "context": {"period": "FY24"}}, {**ok, "subject": " "}])]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, r string").select("k", extraction.parse_payload(extraction.strip_code_fences(F.col("r"))).alias("p")).orderBy("k").collect()
    assert [len(r.p.facts) for r in got] == [1, 1, 1, 1, 0, 0, 1] and [r.p.error is None for r in got] == [True, True, True, True, False, False, True]
    assert got[0].p.facts[0].confidence == 1 and got[0].p.facts[0].value_raw == "5" and got[6].p.facts[0].period == "FY24"


def test_extraction_gates_with_replayed_replies(spark):
    page = "Revenue was 5 Cr.  Growth was strong."
    pages = spark.createDataFrame([("d", "doc", 0, 1, page), ("d", "doc", 1, 2, "  "), ("d", "doc", 2, 3, "unknown")], "doc_id string, source_doc string, page_index int, page_number int, text string")
    facts = [{"subject": "S", "attribute": a, "value_raw": v, "unit": u, "evidence_span": e} for a, v, u, e in (("r", "5", "Cr", "Revenue was 5 Cr."), ("g", "strong", "percent", "Growth was strong."), ("x", "1", None, "not there"), ("w", "5", None, "Cr. Growth"))]
    prompts = pages.select(F.sha2(extraction.build_prompt(F.col("text"), F.col("source_doc"), F.col("page_number")), 256).alias("prompt_hash"), F.when(F.col("page_number") == 1, json.dumps(facts)).alias("reply"))
    got = {r.page_number: r for r in extraction.extract_page_facts(pages, extraction.replay(prompts.where("reply is not null"))).collect()}
    assert set(got) == {1, 3} and [f.attribute for f in got[1].facts] == ["r"] and (got[1].unverbatim, got[1].valueless) == (2, 1) and got[3].error == "no reply"
    relaxed = extraction.extract_page_facts(pages, extraction.replay(prompts.where("reply is not null")), exact=False)
    assert [f.attribute for f in relaxed.where("page_number = 1").first().facts] == ["r", "w"]


def test_adjudication_may_only_explain(spark):
    rows = [(1, '{"reason_text": " new\\n words ", "confidence": 2}'), (2, '{"verdict": "contradict", "reason_text": "no", "confidence": 0.1}'), (3, "junk"), (4, '[{"confidence": 0.2}]'), (5, json.dumps({"verdict": "corroborate", "reason_text": "y" * 400}))]
    frame_ = spark.createDataFrame(rows, "k int, r string").select("k", F.lit("corroborate").alias("verdict"), F.lit("rules").alias("reason_text"), F.lit(0.5).alias("confidence"), adjudication.parse_adjudication(extraction.strip_code_fences(F.col("r"))).alias("reply"))
    got = {r.k: (r.reason_text, r.confidence, r.adjudicated) for r in adjudication.apply_adjudication(frame_).collect()}
    assert got == {1: ("new words", 0.5, True), 2: ("rules", 0.5, False), 3: ("rules", 0.5, False), 4: ("rules", 0.2, True), 5: ("y" * 300, 0.5, True)}


def test_page_selection(spark):
    specs = spark.createDataFrame([(0, "3-5, 10;14"), (1, "5-3"), (2, " "), (3, None)], "k int, s string")
    assert [r.p for r in specs.select("k", page_sources.page_ranges(F.col("s")).alias("p")).orderBy("k").collect()] == [[3, 4, 5, 10, 14], [3, 4, 5], None, None]
    with pytest.raises(Exception):
        specs.select(page_sources.page_ranges(F.lit("a-b"))).collect()
    pages = spark.createDataFrame([("d", n) for n in range(1, 9)], "doc_id string, page_number int")
    assert sorted(r.page_number for r in page_sources.select_pages(pages, {2, 4, 6}, 2).collect()) == [2, 4]


def test_sources_from_files(spark, tmp_path):
    (tmp_path / "a.report.txt").write_text("one two\fthree")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 stuff")
    (tmp_path / "y.pdf").write_bytes(b"no pdf")
    pages = page_sources.text_pages(spark, str(tmp_path), "c")
    assert [(r.source_doc, r.page_number, r.text) for r in pages.orderBy("page_index").collect()] == [("a.report", 1, "one two"), ("a.report", 2, "three")]
    assert page_sources.words(pages).count() == 3
    documents = page_sources.binary_documents(spark, str(tmp_path), "c")
    assert [r.filename for r in documents.collect()] == ["x.pdf"]
    parsed = page_sources.parse_documents(documents, lambda raw: [(None, raw.decode()), ("ii", "end")])
    assert [(r.page_index, r.page_label) for r in parsed.orderBy("page_index").collect()] == [(0, None), (1, "ii")]


def test_label_files(spark, tmp_path):
    entry = {"id": 1, "Metric": "revenue", "value": 5.0, "page": "6, 9;x", "source_doc": "a.pdf", "collection": "c"}
    for shape, content in (("list", [entry]), ("under 'labels'", {"labels": [entry]}), ("by document", {"b.pdf": [{k: v for k, v in entry.items() if k != "source_doc"}]})):
        path = tmp_path / f"{len(shape)}.json"
        path.write_text(json.dumps(content))
        found = label_files.load_labels(spark, str(path))
        assert found.shape == shape and found.unmapped == ["collection"] and found.rows[0]["pages"] == [6, 9] and found.rows[0]["value"] == "5.0"
        assert found.frame(spark).first().document == ("b.pdf" if shape == "by document" else "a.pdf")
    for bad in ("{", "[]", '{"a": 1}', '[{"x": 1}]', "[1]"):
        with pytest.raises(label_files.LabelFormatError):
            label_files.parse_labels(bad)


def greedy(edges):
    used_l, used_f, out = set(), set(), set()
    for s, left, right in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if left not in used_l and right not in used_f:
            used_l.add(left)
            used_f.add(right)
            out.add((left, right))
    return out


def test_greedy_rounds_equal_the_sequential_choice(spark):
    rng = random.Random(3)
    for _ in range(3):
        edges = [(rng.randint(1, 4) / 4, *p) for p in itertools.product(range(9), range(8)) if rng.random() < 0.5]
        got = evaluation.greedy_matching(spark.createDataFrame([(a, b, s) for s, a, b in edges], "label_ord long, fact_ord long, similarity double"))
        assert {(r.label_ord, r.fact_ord) for r in got.collect()} == greedy(edges)


def test_greedy_matching_finishes_what_the_rounds_leave(spark):
    tied = [(1.0, *p) for p in itertools.product(range(7), range(9))]
    chain = [(1 - k / 100, 20 + (k + 1) // 2, 20 + k // 2) for k in range(20)]
    frame = spark.createDataFrame([(a, b, s) for s, a, b in tied + chain], "label_ord long, fact_ord long, similarity double")
    got = {(r.label_ord, r.fact_ord) for r in evaluation.greedy_matching(frame, rounds=2).collect()}
    assert got == greedy(tied + chain) and len(got) > 7


def test_fuzzy_grounding_quotes_whole_turns(spark, tmp_path):
    from factloom.operators.grounding import fuzzy_window
    from factloom.plans.documents import fuzzy_grounding

    turns = [
        (1, 0, "user", "Short one. The second sentence of this turn goes on for a good while.\nAnd a third line follows it here."),
        (1, 1, "assistant", "Replies are quoted too, with all of their sentences. This is the last of them."),
        (2, 0, "user", "Yes"),
        (2, 1, "user", " ".join(f"w{k}" for k in range(1200))),
    ]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(int(r.doc_id), r.page_index): r for r in fuzzy_grounding(spark, str(tmp_path)).collect()}
    assert got.keys() == {(c, t) for c, t, _, _ in turns} and got[2, 0].grounding_method == "search_for"
    for c, t, _, text in turns:
        words = text.split(" ")
        if len(words) > 1:
            score, matched = fuzzy_window(" ".join(words[:1] + words[2:]), text, 0.85)
            assert got[c, t].found_on == t and (got[c, t].score, got[c, t].matched_text) == (round(score, 6), matched)


def test_evaluation(spark):
    facts = normalize_facts(frame(spark, fact("a", "5", "₹ Cr"), fact("a", "7", "percent", attribute="margin"), fact("a", "x", attribute="headcount"), fact("a", "9", "₹", attribute="tax")))
    facts = facts.withColumn("fact_ord", F.when(F.col("attribute") == "revenue", 0).when(F.col("attribute") == "margin", 1).when(F.col("attribute") == "tax", 3).otherwise(2).cast("long"))
    entries = [("reports/a.pdf", "revenue", "50", "₹ million", [1]), ("a.pdf", "revenue", "5", "₹ Cr", [4]), ("a.pdf", "margin", "9", "percent", []), ("b.pdf", "tax", "9", "₹", []), (None, "zebra stripes", "1", None, [])]
    labels = spark.createDataFrame([(k, d, "Acme", a, v, u, "FY24", p) for k, (d, a, v, u, p) in enumerate(entries)], "label_ord long, document string, subject string, attribute string, value string, unit string, period string, pages array<int>")
    matches, misses, spurious = evaluation.outcome(labels, facts)
    assert [(r.label_ord, r.fact_ord, r.page_agrees) for r in matches.collect()] == [(0, 0, True)]
    assert {r.label_ord: r.cause for r in misses.collect()} == {1: "value_mismatch", 2: "value_mismatch", 3: "not_extracted", 4: "not_extracted"}
    assert {r.fact_ord: r.scoped for r in spurious.collect()} == {1: True, 2: False, 3: True}
    m = evaluation.metrics(labels, matches, spurious)
    r = m.first()
    assert (r.tp, r.labels, r.spurious, r.scoped_spurious) == (1, 5, 3, 2) and r.recall == 0.2 and r.precision == 0.25 and r.f1 == pytest.approx(2 * (1 / 3) * 0.2 / (1 / 3 + 0.2))
    assert "recall 0.200" in evaluation.report(m, misses)
    none = evaluation.metrics(labels.limit(0), matches.limit(0), spurious.limit(0)).first()
    assert (none.recall, none.precision, none.f1) == (0, 0, 0)


def test_similarity_join_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["net", "total", "revenue", "revenues", "income", "profit", "tax", "margin", "cost", "of", "sales", "growth", "rate", "per", "share"]
    texts = ["", "-", "é", "x", *{" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(150)}]
    some, other = texts[:80] + texts[:1], texts[:4] + texts[60:]
    a, b = (spark.createDataFrame([(t,) for t in [*x, None]], f"{c} string") for c, x in (("l", some), ("r", other)))
    for threshold in (0.3, 0.55, 0.9):
        got = {(r.l, r.r): r.s for r in similarity.similarity_join(a, "l", b, "r", threshold, "s").collect()}
        want = {(x, y): 1.0 if x == y else similarity.text_cosine(x, y) for x in some for y in other}
        want = {k: v for k, v in want.items() if v >= threshold}
        assert got == pytest.approx(want) and len(want) > 20
    none = similarity.similarity_join(a.limit(0), "l", b, "r", 0.5, "s")
    assert none.isEmpty() and "NestedLoop" not in none._jdf.queryExecution().toString() and "Cartesian" not in none._jdf.queryExecution().toString()


def test_store_and_read_api(spark, tmp_path):
    store = SnapshotStore(spark, "file://" + str(tmp_path / "store"))
    assert store.read("facts") is None
    with pytest.raises(NotFound):
        ReadApi(store).facts("c")
    store.upsert("collections", spark.createDataFrame([("c", "c", "t0")], "collection_id string, name string, created_at string"))
    store.upsert("collections", spark.createDataFrame([("c", "Named", "t1")], "collection_id string, name string, created_at string"))
    store.upsert("documents", spark.createDataFrame([("a", "c", "p", "t0"), ("b", "c", None, "t0")], "doc_id string, collection_id string, path string, created_at string"))
    store.upsert("documents", spark.createDataFrame([("a", "x", None, "t1"), ("b", "c", "q", "t1")], "doc_id string, collection_id string, path string, created_at string"))
    assert {(r.doc_id, r.collection_id, r.path, r.created_at) for r in store.read("documents").collect()} == {("a", "c", "p", "t0"), ("b", "c", "q", "t0")}
    reconcile_batch(store, frame(spark, fact("a", "5", "₹", evidence="CIN L00001MH1995PLC000001"), fact("a", "50", "₹", attribute="tax")))
    assert store.read("relationships").count() == 0
    reconcile_batch(store, frame(spark, fact("b", "9", "₹", evidence="CIN L00001MH1995PLC000001"), fact("b", "50", "₹", attribute="tax")))
    api = ReadApi(store)
    row, documents, verdicts = api.collection("c")
    assert (row.first().name, row.first().created_at, row.first().document_count, row.first().fact_count) == ("Named", "t0", 2, 4)
    assert {r.doc_id: r.fact_count for r in documents.collect()} == {"a": 2, "b": 2} and {r.verdict: r.n for r in verdicts.collect()} == {"contradict": 1, "corroborate": 1}
    found, totals = api.relationships("c", verdict="contradict")
    assert found.first().inline_a.value_raw in "59" and totals.count() == 2
    shown = api.facts("c", subject="acme", attribute="TAX").collect()
    assert len(shown) == 2 and shown[0].context.period == "FY24" and shown[0].comparable and shown[0].evidence_url.endswith("/evidence")
    with pytest.raises(NotFound):
        api.collection("nope")
    with pytest.raises(ValueError):
        api.facts("c", limit=0)
    assert "<td>Acme Ltd</td>" in api.debug_html("c")
    store.delete_facts("a", {1})
    assert store.read("facts").count() == 2
    store.vacuum("facts")
    assert len(store.versions("facts")) == 2
    assert store.new_only("documents", spark.createDataFrame([("a",), ("z",)], "doc_id string")).collect()[0].doc_id == "z"
    vectors = embedded(store, spark.createDataFrame([("x y",), ("x y",), (None,)], "text string"), hash_embed, MODEL)
    assert vectors.count() == 1 and embedded(store, spark.createDataFrame([("x y",), ("z",)], "text string"), hash_embed, MODEL).count() == 2


def test_upsert_adds_columns(spark):
    old = spark.createDataFrame([("f1", "s")], "fact_id string, subject string")
    new = spark.createDataFrame([("f1", "t", 1), ("f2", "u", 2)], "fact_id string, subject string, page int")
    assert {tuple(r) for r in upserted(old, new, "facts").select("fact_id", "subject", "page").collect()} == {("f1", "s", 1), ("f2", "u", 2)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [fact(d, v, "₹", evidence="CIN L00001MH1995PLC000001", n=k) for k, (d, v) in enumerate((("a", "5"), ("b", "5"), ("c", "9"), ("a", "6")))]
    whole = SnapshotStore(spark, "file://" + str(tmp_path / "whole"))
    reconcile_batch(whole, frame(spark, *rows))
    frame(spark, *rows).repartition("source_doc").write.parquet(str(tmp_path / "in"))
    parts = SnapshotStore(spark, "file://" + str(tmp_path / "parts"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    reconcile_stream(parts, stream, str(tmp_path / "checkpoint")).awaitTermination()
    key = ["relationship_id", "verdict", "reason_code"]
    assert sorted(map(tuple, whole.read("relationships").select(*key).collect())) == sorted(map(tuple, parts.read("relationships").select(*key).collect()))


def test_stream_keeps_facts_of_a_document_split_over_batches(spark, tmp_path):
    rows = [fact(d, v, "₹", evidence="CIN L00001MH1995PLC000001", n=k) for k, (d, v) in enumerate((("a", "5"), ("b", "5"), ("a", "6")))]
    store = SnapshotStore(spark, "file://" + str(tmp_path / "store"))
    for k, row in enumerate(rows):  # the first document comes in two batches
        frame(spark, row).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        reconcile_stream(store, stream, str(tmp_path / "checkpoint")).awaitTermination()
        assert store.read("facts").count() == k + 1
    assert store.read("relationships").count() == 2


def test_a_batch_that_failed_half_way_is_done_again(spark, tmp_path, monkeypatch):
    from factloom.streaming.incremental import new_facts_only

    rows = [fact(d, "5", "₹", evidence="CIN L00001MH1995PLC000001") for d in "ab"]
    store = SnapshotStore(spark, "file://" + str(tmp_path / "store"))
    publish = SnapshotStore.publish

    def broken(self, table, frame_of):
        if table == "facts":
            raise OSError("lost")
        return publish(self, table, frame_of)

    monkeypatch.setattr(SnapshotStore, "publish", broken)
    with pytest.raises(OSError, match="lost"):
        reconcile_batch(store, frame(spark, *rows))
    monkeypatch.undo()
    again = new_facts_only(store, frame(spark, *rows))
    assert again.count() == 2
    reconcile_batch(store, again)
    assert store.read("facts").count() == 2 and store.read("relationships").count() == 1
    assert "created_at" in store.read("facts").columns and new_facts_only(store, frame(spark, *rows)).count() == 0


def test_grounding_tries_home_in_all_ways_first(spark):
    quote = "revenue grew by nine per cent in the year under review"
    pages = spark.createDataFrame([("d", 0, "so revenue grew by nine per cent in that year under review too"), ("d", 5, quote)], "doc_id string, page_index int, text string")
    asked = spark.createDataFrame([("d", quote, 0), ("d", quote, None), ("d", quote, 3)], "doc_id string, quote string, page_index int")
    got = {r.page_index: (r.found_on, r.grounding_method) for r in grounding.ground_quotes(asked, pages).collect()}
    assert got == {0: (0, "fuzzy"), None: (5, "search_for"), 3: (5, "search_for")}


def test_fuzzy_windows_equal_a_search_of_all(spark):
    from difflib import SequenceMatcher

    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Ép", "ﬁne", "net", "of", "the", "—"]
    for _ in range(150):
        page = [rng.choice(vocabulary) for _ in range(rng.randint(1, 25))]
        at = rng.randrange(len(page))
        words = page[at : at + rng.randint(1, 7)]
        quote = " ".join(w if rng.random() < 0.8 else rng.choice(vocabulary) for w in words)
        needle, best = grounding.fold(quote), None
        length = len(needle.split())
        tokens = [grounding.fold(w) for w in page]
        for width in [w for w in range(max(1, length - 2), length + 3) if w <= len(page)] or [len(page)]:
            for k in range(len(page) - width + 1):
                score = SequenceMatcher(None, " ".join(tokens[k : k + width]), needle, autojunk=False).ratio()
                if score >= 0.85 and (best is None or score > best[0]):
                    best = score, " ".join(page[k : k + width])
        assert grounding.fuzzy_window(quote, " ".join(page)) == best


def test_unreadable_replies_are_asked_for_once_more(spark):
    from factloom.operators.extraction import REMINDER

    pages = spark.createDataFrame([("d", "doc", 0, 1, "sales were 5 crore"), ("d", "doc", 1, 2, "more text")], "doc_id string, source_doc string, page_index int, page_number int, text string")
    good = json.dumps([{"subject": "A", "attribute": "sales", "value_raw": "5", "evidence_span": "sales were 5 crore"}])

    def propose(prompts):
        mine = F.col("prompt").endswith(REMINDER) & F.col("prompt").contains("sales")
        return prompts.withColumns({"reply": F.when(mine, good).otherwise("no list"), "error": F.lit(None).cast("string")})

    got = {r.page_index: r for r in extraction.extract_page_facts(pages, propose).collect()}
    assert got[0].error is None and len(got[0].facts) == 1 and got[1].error and got[1].facts == []


def test_pages_that_labels_cite():
    assert label_files.read_pages("3; 4,x, 5") == [3, 4, 5] and label_files.read_pages([1, "2", None, 1.5]) == [1, 2] and label_files.read_pages(7) == [7] and label_files.read_pages(None) == []
