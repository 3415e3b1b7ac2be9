"""Enriched rows as the specification writes them, predictions with one call a row, native items against Python's JSON."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberlog.functions.records import generation_items
from emberlog.functions.textfx import json_string
from emberlog.operators import actions, evaluation, gate, training
from emberlog.sources import readers

ODD = ['{"Action": "a"}', '{"ACTION": "a", "action": "b"}', '{"action": null, "response": "x"}', ' {"Text":"t\\u00e9\\n\\"q\\"", "host" : "h"}\n', '{"a": "\\ud83d\\ude00"}', '{"a": {"b": "c"}}', '{"targets": ["a", "b"], "risk": 1}', "[]", "{}", '{"a": "b",}', '{"a": "b"} x', "plain", 'x {"Action": "y"} z', '{"actions": "none"}', '{"actions": [{"plan": "p"}]}', '"text"', "null", '{"a": "tab\there"}', '{"action": "", "text": "u"}', '{"Action": " padded ", "evidence": "e, f"}', "", "{", "é [", '{"explanation": "only"}', '{"action": "x", "action": "y"}']


def test_items_are_those_of_python(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "k long, generation string")
    got = {r.k: [i.asDict() for i in r["items"]] for r in actions.with_items(rows).collect()}
    for k, text in enumerate(ODD):
        want = generation_items(text, "string") if text else [dict.fromkeys(got[k][0], "")]
        assert got[k] == want, text


def test_json_strings(spark):
    texts = ["", 'q"b\\', "".join(map(chr, range(128))), "é 😀", "\\u001F", "a/b"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(json_string(F.col("t"))).collect()] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_enriched_instruction_is_the_whole_text(spark):
    rows = spark.createDataFrame([(3, 'ssh login failed "x" \\ src=10.0.0.5 host=web-01 CVE-2024-12345 http://c2.example/p\té', "a"), (4, "  ", "b"), (5, None, None)], "source_index long, instruction string, answer string")
    for r in training.enrich(rows, observed_at="2024-01-01T00:00:00+00:00").collect():
        incident = r.metadata.incident.asDict(recursive=True)
        body = r.instruction.split("<incident_json>\n")[1].split("\n</incident_json>")[0]
        assert body == json.dumps(incident, ensure_ascii=False, indent=2)
        assert r.instruction.endswith(f"<kg_rag_context>\n{r.metadata.kg_rag.prompt_context}\n</kg_rag_context>") and r.instruction.startswith((r.original_instruction or "").strip() + "\n\n")


def test_predictions_call_the_model_once_a_row(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def generate(text):
        import uuid

        name = uuid.uuid4().hex
        (Path(str(log)) / name).write_text(text)
        return json.dumps({"Action": f"Isolate host {name} and preserve logs.", "Explanation": "seen"})

    rows = spark.createDataFrame([(k // 2, f"text {k}", "x") for k in range(10)], "source_index long, instruction string, answer string")
    made = training.predictions(rows, generate, "m", 2025).collect()
    assert len(made) == 10 == len(list(log.iterdir()))
    assert all(json.loads(r.generation)["Action"] == r.post_processing.actions[0].action.source_action for r in made)
    assert Counter(r.id for r in made) == {str(k): 2 for k in range(5)}
    other = training.predictions(rows, lambda t: "x", "m", 2025, processor=lambda df, key, year, **o: gate.process(df, key, year, **o).withColumn("accepted", F.lit(False)))
    assert {r.post_processing.accepted for r in other.collect()} == {False}
    plain = training.predictions(rows, lambda t: t[::-1], "m", 2025, post_process=False).first()
    assert plain.post_processing is None and plain.generation == plain.instruction[::-1]


def test_gate_options_and_evaluator(spark):
    rows = spark.createDataFrame([(0, "Patch CVE-2024-0001 now")], "record_index long, generation string")
    found = lambda **o: [f.category for f in gate.process(rows, "record_index", 2025, **o).first().findings]
    assert "cve_authenticity" not in found() and "cve_authenticity" in found(allowed_cves=["CVE-2020-1"])
    assert "cve_authenticity" not in found(allowed_cves=["cve-2024-0001"]) and "cve_authenticity" not in found(allowed_cves=["CVE-2020-1"], require_context_cve_match=False)
    calls = []

    def evaluate(records, year, **options):
        calls.append(options)
        return evaluation.evaluate_actions(records, year).withColumn("unsafe", F.lit(True))

    compared = evaluation.compare_models(rows, rows, 2025, evaluate=evaluate).where("metric = 'unsafe_action_rate'").first()
    assert compared.baseline_rate == 1.0 and calls == [{}]


def test_preprocess_and_readers(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"ssh host=h{k}", "x") for k in range(9)], "source_index long, instruction string, answer string")
    assert training.preprocess(rows, str(tmp_path / "p"), 0.25, 11, limit=8) == {"original_test": 2, "original_train": 6, "enriched_test": 2, "enriched_train": 6}
    with pytest.raises(ValueError, match="limit"):
        training.limited(rows, -1)
    (tmp_path / "i.json").write_text('{"incident_id": "a", "cves": ["CVE-2024-1"]}')
    row = readers.incident_json(spark, str(tmp_path / "i.json")).first()
    assert (row.severity, row.source, row.cves, row.iocs) == ("unknown", "log_parser", ["CVE-2024-1"], [])
    (tmp_path / "bad.json").write_text('{"severity": "low"}')
    with pytest.raises(Exception, match="incident_id is missing"):
        readers.incident_json(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "acts.txt").write_text("Block a\n\nBlock b\n")
    assert [(r.generation, r.kind) for r in readers.action_file(spark, str(tmp_path / "acts.txt")).orderBy("pos").collect()] == [("Block a", "item"), ("Block b", "item")]
    assert readers.action_file(spark, str(tmp_path / "acts.txt"), 1).count() == 1
    assert readers.inline_text(spark, "x", "i").count() == 1 and readers.context_document(spark, None).first().context is None
    (tmp_path / "c.json").write_text('{"incident": {"cves": ["CVE-2024-1"]}, "nodes": []}')
    assert readers.context_document(spark, str(tmp_path / "c.json")).first().context.incident.cves == ["CVE-2024-1"]
    training.enrich(rows).write.parquet(str(tmp_path / "kept"))
    assert readers.training_examples(spark, "kg_rag", str(tmp_path / "kept"), 3).count() == 3
    with pytest.raises(ValueError, match="unknown training mode"):
        readers.training_examples(spark, "x", "y")
    assert readers.pick_instruction(rows, 5).first() == readers.pick_instruction(rows, 5).first()
