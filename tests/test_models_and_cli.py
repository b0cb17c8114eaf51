"""Model calls with refusals, and the command line end to end."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.operators.extraction import build_prompt
from factloom.operators.models import Calling, ModelError, QuotaExhausted, Spacer, call, called, quota
from factloom.sources.labels import find_documents
from factloom.sources.store import SnapshotStore


class Scripted:
    def __init__(self, *steps):
        self.steps, self.slept = list(steps), []

    def __call__(self, prompt):
        step = self.steps.pop(0)
        if isinstance(step, Exception):
            raise step
        return step


def run(*steps, **how):
    model = Scripted(*steps)
    return model, call(model, "p", Calling(**{"spacing": 0, **how}), Spacer(0, model.slept.append))


def test_retries():
    model, reply = run(ModelError("busy", 503), ModelError("busy", 500), "ok")
    assert reply == "ok" and len(model.slept) == 2 and 0.5 <= model.slept[0] <= 1.5 <= 2 * model.slept[1] <= 6
    model, reply = run(ModelError("wait: retry in 7.5s", 429), "ok")
    assert model.slept == [7.5]
    with pytest.raises(ModelError):
        run(ModelError("bad request", 400), "ok")
    with pytest.raises(ModelError):
        run(*[ModelError("busy", 503)] * 4)
    with pytest.raises(QuotaExhausted):
        run(ModelError("GenerateRequestsPerDay", 429), "ok")
    with pytest.raises(QuotaExhausted):
        run(*[ModelError("slow down", 429)] * 4)
    assert quota("{'retryDelay': '12s'}") == (False, 12.0) and quota("limit per day") == (True, None)


def test_spacing():
    clock, slept = [0.0], []
    spacer = Spacer(6, lambda s: (slept.append(s), clock.__setitem__(0, clock[0] + s)), lambda: clock[0])
    spacer.wait()
    clock[0] += 2
    assert spacer.wait() == 4 and slept == [4]
    clock[0] += 9
    assert spacer.wait() == 0


def test_quota_ends_a_partition_and_keeps_the_rest(spark):
    def model(prompt):
        if prompt == "c":
            raise ModelError("PerDay", 429)
        if prompt == "b":
            raise ModelError("no", 400)
        return prompt.upper()

    prompts = spark.createDataFrame([(x,) for x in "abcd"], "prompt string").coalesce(1)
    got = {r.prompt: (r.reply, r.error) for r in called(model, Calling(spacing=0))(prompts).collect()}
    assert got["a"] == ("A", None) and got["b"] == (None, "no") and got["c"][0] is None and got["d"][1] == got["c"][1]
    spark.conf.set("factloom.model.attempts", "2")
    assert Calling.from_conf(spark) == Calling(attempts=2)


def test_documents_of_labels(spark):
    labels = spark.createDataFrame([("x/A.Report.pdf",), ("gone.pdf",), (None,)], "document string")
    files = spark.createDataFrame([("/d/a.report.pdf", "a.report")], "path string, source_doc string")
    found, missing = find_documents(labels, files)
    assert [tuple(r) for r in found.collect()] == [("x/A.Report.pdf", "/d/a.report.pdf")] and [r.document for r in missing.collect()] == ["gone.pdf"]


def test_command_line(spark, tmp_path, capsys):
    texts = {"alpha": "Acme Ltd earned ₹ 50 million in FY24.", "beta": "In FY24 Acme Limited earned ₹ 5 Cr."}
    replies = []
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.txt").write_text(text)
        value, unit = ("50", "₹ million") if name == "alpha" else ("5", "₹ Cr")
        prompt = spark.range(1).select(F.sha2(build_prompt(F.lit(text), F.lit(name), F.lit(1)), 256)).first()[0]
        fact = {"subject": "Acme Ltd", "attribute": "revenue", "value_raw": value, "unit": unit, "period": "FY24", "evidence_span": text}
        replies.append(json.dumps({"prompt_hash": prompt, "reply": json.dumps([fact])}))
    (tmp_path / "replies.json").write_text("\n".join(replies))
    (tmp_path / "labels.json").write_text(json.dumps([{"doc": "alpha.pdf", "attribute": "revenue", "value": "50", "unit": "₹ million", "page": 1}]))
    store = "file://" + str(tmp_path / "store")
    assert cli.main(["ingest", "--input", str(tmp_path / "in"), "--store", store, "--replies", str(tmp_path / "replies.json")], spark) == 0
    assert [r.reason_code for r in SnapshotStore(spark, store).read("relationships").collect()] == ["unit_diff_resolved"]
    assert cli.main(["evaluate", "--labels", str(tmp_path / "labels.json"), "--store", store, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["recall"] == 1.0
    assert cli.main(["ground", "--input", str(tmp_path / "in"), "--quote", "earned ₹ 5 Cr"], spark) == 0
    assert cli.main(["ground", "--input", str(tmp_path / "in"), "--quote", "nothing of this kind at all"], spark) == 1
