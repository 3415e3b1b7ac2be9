"""The command line: one document of each command, written reports, and its errors."""

import json

import pytest
from pyspark.sql import Row

from emberlog import cli
from emberlog.operators import training
from emberlog.sources import readers, writers

LINE = "Critical SSH brute force src=10.0.0.5 host=web-01 service=sshd CVE-2024-12345"


def run(spark, *argv):
    return cli.main([str(a) for a in argv], spark)


def test_incident_and_context(spark, tmp_path, capsys):
    (tmp_path / "log.txt").write_text(f"{LINE}\n\nsecond line\n")
    made = run(spark, "incident", "--input", tmp_path / "log.txt", "--incident-id", "i-1")
    assert json.loads(capsys.readouterr().out) == made
    assert made["incident_id"] == "i-1" and made["cves"] == ["CVE-2024-12345"] and made["raw_events"] == [LINE, "second line"] and made["observed_at"].startswith("20")
    assert run(spark, "incident", "--text", LINE)["incident_id"].startswith("incident-20")
    (tmp_path / "i.json").write_text(json.dumps(made))
    from_logs = run(spark, "context", "--input", tmp_path / "log.txt", "--incident-id", "i-1")
    from_json = run(spark, "context", "--incident-json", tmp_path / "i.json")
    assert from_json["prompt_context"] == from_logs["prompt_context"] != "" and from_json["nodes"] == from_logs["nodes"]
    assert len(run(spark, "context", "--text", LINE, "--depth", 0)["nodes"]) == 1
    with pytest.raises(SystemExit):
        run(spark, "incident")


def test_actions(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"Action": "Block 10.0.0.5 at the firewall."}\nIsolate host web-01.\n\n')
    made = run(spark, "actions", "--input", tmp_path / "a.txt")
    assert [a["source_action"] for a in made] == ["Block 10.0.0.5 at the firewall.", "Isolate host web-01."]
    assert len(run(spark, "actions", "--input", tmp_path / "a.txt", "--limit", 1)) == 1
    assert run(spark, "actions", "--text", "Isolate host web-01.") == made[1:]
    (tmp_path / "c.json").write_text(json.dumps({"instructions": [["a", "b"]], "answers": [["Isolate host web-01.", "x"]]}))
    assert run(spark, "actions", "--from-dataset", tmp_path / "c.json", "--limit", 1) == made[1:]
    run(spark, "actions", "--input", tmp_path / "a.txt", "--output", tmp_path / "out")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_gate_evaluate_compare(spark, tmp_path):
    bad = '{"Action": "Patch CVE-2023-11111 on web-01"}'
    (tmp_path / "k.json").write_text(json.dumps(run(spark, "context", "--text", LINE)))
    strict = run(spark, "gate", "--generation", bad, "--kg-context", tmp_path / "k.json", "--as-of-year", 2025)
    assert "cve_authenticity" in {f["category"] for f in strict["findings"]}
    for more in (["--allow-external-cves"], ["--allowed-cve", "cve-2023-11111"]):
        loose = run(spark, "gate", "--generation", bad, "--kg-context", tmp_path / "k.json", "--as-of-year", 2025, *more)
        assert "cve_authenticity" not in {f["category"] for f in loose["findings"]}
    (tmp_path / "empty.txt").write_text("")
    assert run(spark, "gate", "--input", tmp_path / "empty.txt")["accepted"]
    context = json.loads((tmp_path / "k.json").read_text())
    for name, text in (("base", bad), ("tuned", '{"Action": "Isolate host web-01"}')):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"id": k, "generation": text, "kg_context": context}) for k in range(2)))
    one = run(spark, "evaluate", "--input", tmp_path / "base.jsonl", "--output", tmp_path / "report", "--as-of-year", 2025)
    assert one["record_count"] == 2 and one["hallucinated_action_rate"] == {"numerator": 2, "denominator": 2, "rate": 1.0}
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "report/report")).collect())) == one
    assert spark.read.parquet(str(tmp_path / "report/actions")).count() == 2
    both = run(spark, "compare", "--baseline-input", tmp_path / "base.jsonl", "--candidate-input", tmp_path / "tuned.jsonl", "--as-of-year", 2025)
    listed = both["baseline"].pop("action_evaluations")
    assert [(a["record_index"], a["action_index"], a["hallucinated"]) for a in listed] == [(0, 0, True), (1, 0, True)] and listed[0]["findings"]
    assert both["baseline"] == one and both["baseline_name"] == "base" and both["paired_record_count"] == 2
    assert both["hallucinated_action_rate"] == {"baseline_rate": 1.0, "candidate_rate": 0.0, "absolute_change": -1.0, "absolute_improvement": 1.0, "relative_reduction": 1.0}
    assert both["incorrect_command_rate"]["relative_reduction"] is None
    (tmp_path / "short.jsonl").write_text(json.dumps({"id": 0, "generation": bad}))
    with pytest.raises(ValueError):
        run(spark, "compare", "--baseline-input", tmp_path / "base.jsonl", "--candidate-input", tmp_path / "short.jsonl")


def test_preprocess_and_corpus_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"instructions": [[LINE] * 5], "answers": [list("abcde")]}))
    made = run(spark, "preprocess", "--data-file", tmp_path / "c.json", "--output", tmp_path / "p")
    assert made["enriched_train"] == made["original_train"] == 4 and made["enriched_test"] == 1
    plain = run(spark, "preprocess", "--mode", "original", "--data-file", tmp_path / "c.json", "--output", tmp_path / "q", "--limit", 4)
    assert plain["train_examples"] == 3 and plain["test_examples"] == 1
    examples = readers.training_json(spark, str(tmp_path / "c.json"))
    writers.corpus_document(training.enrich(examples), str(tmp_path / "e.json"))
    read = readers.preprocessed(spark, str(tmp_path / "e.json"), 3)
    assert read.count() == 3 and read.first().metadata.validation.ok
    rows = [{"instructions": [["i"]], "answers": [["a"]], "metadata": [[{"validation": {"ok": False, "errors": ["e"]}}]]}]
    (tmp_path / "f.json").write_text(json.dumps(rows[0]))
    with pytest.raises(ValueError):
        readers.preprocessed(spark, str(tmp_path / "f.json"))
    assert readers.preprocessed(spark, str(tmp_path / "c.json")).count() == 5
    with pytest.raises(FileNotFoundError):
        readers.preprocessed(spark, str(tmp_path / "none.json"))
    assert readers.answers(spark, str(tmp_path / "c.json"), 2).collect() == [Row(source_index=0, answer="a"), Row(source_index=1, answer="b")]
    assert readers.pick_instruction(examples).count() == 1 and readers.pick_instruction(examples, 7).first() == readers.pick_instruction(examples, 7).first()
