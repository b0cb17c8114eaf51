"""What must hold as tables grow: no task that reads a whole document's facts, no nested loops, bounded batches."""

import contextlib
import io
import math
import random
import time
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

import __spark_entry__ as entry
from factloom.functions.base import in_slices
from factloom.operators import extraction, grounding
from factloom.operators.facts import bind_self_references, bind_strong_keys, resolve
from factloom.operators.nearest import nearest
from factloom.sources.store import SnapshotStore


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def cosine_of(a, b):
    if not a or not b or len(a) != len(b) or None in a or None in b:
        return 0.0
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b)) / norms)) if norms > 0 else 0.0


def test_nearest_equals_brute_force(spark):
    draw = random.Random(5)
    base = [[draw.choice([0.0, 1.0, -1.0, draw.gauss(0, 1)]) for _ in range(6)] for _ in range(120)]
    rows = [(i, draw.choice(base)) for i in range(400)]  # with many copies
    rows += [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [1.0] * 5), (1004, [1.0] * 5), (1005, [None] + [1.0] * 5), (None, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    queries = [(i, v) for i, v in rows if i is not None and (i % 50 == 0 or i >= 1000)]
    want = []
    for q, v in queries:
        ranked = sorted((-round(cosine_of(v, w), 6) + 0.0, i) for i, w in rows if i is not None and i != q)[:5]
        want += [(q, i, -s + 0.0, n) for n, (s, i) in enumerate(ranked, 1)]
    got = nearest(vectors, vectors.where((F.col("id") % 50 == 0) | (F.col("id") >= 1000)), 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_vectors_meet_queries_without_a_nested_loop(spark, sf_dir):
    assert "NestedLoop" not in plan_of(entry.queries()["cosine_topk"](spark, sf_dir))


def stated(spark, n):
    """Facts of one document: on firms by name, on 'the Company', and by number."""
    texts = [("the Company", None), ("Acme Ltd", None), (f"Firm {n}", "CIN U12345DL2001PTC000001")]
    rows = [(f"f{k}", "doc", 1, *texts[k % 3], "revenue", str(k)) for k in range(n)]
    rows.append(("g", "doc", 1, "Acme Ltd", "CIN L00001MH1995PLC000007", "tax", "5"))
    return resolve(spark.createDataFrame(rows, "fact_id string, source_doc string, page int, subject string, evidence_span string, attribute string, value_raw string"))


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_facts_of_one_document_are_bound_in_many_tasks(spark):
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        facts = stated(spark, 3000)
        selves = bind_self_references(facts.where("subject = 'the Company' or fact_id = 'g'"))
        names = bind_strong_keys(facts.where("subject = 'Acme Ltd'"))
        for bound, key in ((selves, "CIN:L00001MH1995PLC000007"), (names, "CIN:L00001MH1995PLC000007")):
            rows = bound.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.min("subject_key").alias("low"), F.max("subject_key").alias("high")).collect()
            assert sum(r.n for r in rows) == 1001 and {r.low for r in rows} == {r.high for r in rows} == {key}
            assert max(r.n for r in rows) < 600


def test_facts_with_stated_identifiers_are_not_moved(spark):
    facts = bind_strong_keys(bind_self_references(stated(spark, 30).where("subject like 'Firm%'")))
    assert "Exchange" not in plan_of(facts) and facts.count() == 10


def test_batches_are_added_to_the_store(spark, tmp_path):
    store = SnapshotStore(spark, "file://" + str(tmp_path / "store"))

    def rows(*values):
        return spark.createDataFrame([(k, v, "t0") for k, v in values], "fact_id string, unit string, created_at string").repartition(2)

    def folders():
        return sorted(p.name for p in (tmp_path / "store" / "facts").iterdir())

    def held():
        return sorted((r.fact_id or "", r.unit) for r in store.read("facts").collect())

    store.upsert("facts", rows(("a", "1"), ("b", "2"), ("b", "1")))
    store.upsert("facts", rows(("c", "3"), (None, "x")))
    store.stage("facts", rows(("z", "9")))  # a failed batch
    assert held() == [("", "x"), ("a", "1"), ("b", "1"), ("c", "3")]
    store.upsert("facts", rows(("d", "4")))
    assert folders() == ["v=1", "v=2~1", "v=3~2"] and store.versions("facts") == [1, 2, 3]
    store.upsert("facts", rows(("a", "7"), ("e", "5"), ("e", "6")))  # a known key: the table is written whole
    assert folders()[-1] == "v=4" and {k: v for k, v in held() if k} == {"a": "7", "b": "1", "c": "3", "d": "4", "e": "5"}
    store.vacuum("facts", 1)
    assert folders() == ["v=4"] and store.read("facts").count() == 6
    store.upsert("facts", rows(("f", "6")))
    store.upsert("facts", rows(("g", "6")))
    store.vacuum("facts", 1)
    assert store.versions("facts") == [6] and store.read("facts").count() == 8


def test_signs_in_common_are_those_of_difflib():
    draw = random.Random(3)
    for _ in range(1500):
        signs = draw.choice(["ab", "abc ", "abcdefgh ", "aé ß"])
        a = [draw.choice(signs) for _ in range(draw.randint(0, 60))]
        b = list(a) if draw.random() < 0.5 else [draw.choice(signs) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 6)):
            k = draw.randint(0, len(b))
            b[k : k + draw.randint(0, 3)] = draw.choice(signs)
        a, b = "".join(a), "".join(b)
        assert grounding.matched_signs(a, b) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_long_windows_are_scored_without_a_scan_of_all_pairs_of_signs():
    draw = random.Random(4)
    words = ["".join(draw.choice("etaoin") for _ in range(5)) for _ in range(4000)]
    page, quote = " ".join(words), " ".join(words[:1] + words[2:])
    began = time.process_time()
    score, text = grounding.fuzzy_window(quote, page)
    assert score > 0.99 and text == page and time.process_time() - began < 5  # over a minute sign by sign


def test_batches_become_python_objects_a_few_at_a_time():
    seen = []
    got = in_slices(pa.array(["a"] * 1000 + [None]), pa.string(), lambda values: seen.append(len(values)) or values)
    assert got.to_pylist() == ["a"] * 1000 + [None] and max(seen) <= 256
    assert in_slices(pa.array([], pa.string()), pa.string(), list).to_pylist() == []
    for udf in (grounding.normalize_text, extraction.parse_payload):
        assert udf.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
