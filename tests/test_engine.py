"""Operators of the incident engine on small inputs, and every query against its SQL at the smallest size."""

import json
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from emberlog.functions import dims
from emberlog.functions.records import document_items, document_records, first_object, generation_items, shell_head
from emberlog.functions.textfx import java
from emberlog.operators import evaluation, gate, graph, incident, training
from emberlog.plans.queries import ORACLE_SQL, QUERIES
from emberlog.sources import readers, writers


def parsed(spark, *lines, name="i1"):
    return incident.parse_lines(spark.createDataFrame([(name, k, x) for k, x in enumerate(lines)], "incident_id string, line_no int, line string"))


def test_incident_fields(spark):
    row = parsed(spark, " CRITICAL ssh login failed src=10.0.0.5 host=web-01 service=sshd cve-2024-12345 CVE-2024-12345 ", "", "powershell payload http://c2.example/p account=alice at 12:34:56 md5 " + "a" * 32).first()
    assert row.cves == ["CVE-2024-12345"] and row.assets == ["web-01", "alice"] and row.severity == "critical"
    assert row.services[0] == "ssh" and row.attack_stages[:2] == ["initial_access", "execution"]
    kinds = [(x.type, x.value) for x in row.iocs]
    assert ("ipv4", "10.0.0.5") in kinds and ("ipv6", "12:34:56") in kinds and ("domain", "c2.example") not in kinds and ("md5", "a" * 32) in kinds
    assert row.summary.startswith("CRITICAL") and len(row.raw_events) == 2


def test_blank_incident_and_port(spark):
    row = parsed(spark, "  ", None).first()
    assert row.severity == "unknown" and row.summary == dims.NO_EVENTS and row.raw_events == []
    assert any(x.type == "domain" for x in parsed(spark, "see http://h.example:8080/x").first().iocs)


@pytest.mark.parametrize("text", ["é203.0.113.9 a.b@c.de, x", "host=a; user: bob", "/usr/bin/x C:\\t\\u,v", "cmd.exe fe80:1:2", "٣٤.1.1.1 rm -rf /", "a.b-c.d.ee." * 50])
def test_java_patterns_find_what_python_finds(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    for p in dims.IOC_PATTERNS.values():
        assert frame.select(F.regexp_extract_all("t", F.lit(java(p)), F.lit(0))).first()[0] == [m[0] for m in re.finditer(p, text)]
    for p in dims.ASSET_PATTERNS:
        assert frame.select(F.regexp_extract_all("t", F.lit(java(p, True)), F.lit(1))).first()[0] == re.findall(p, text, re.I)


def test_graph_depths_and_prompt(spark):
    found = parsed(spark, "exploit CVE-2023-1111 host=m-01 http service exfil upload")
    sizes = [(r.n, r.e) for d in (0, 1, 2, 3) for r in graph.with_graph(found, d).select(F.size("nodes").alias("n"), F.size("edges").alias("e")).collect()]
    assert sizes[0] == (1, 0) and sizes[1][0] < sizes[2][0] and sizes[2] == sizes[3]
    row = graph.contexts(found).first()
    assert [n.id for n in row.nodes] == sorted(n.id for n in row.nodes) and "Patch exposed services" in row.recommendations
    assert row.prompt_context.startswith(dims.PROMPT_LINES[0])
    again = graph.upsert_nodes(spark.createDataFrame([("a", 1, "x", "old", {}), ("a", 2, "y", None, {"k": "v"})], "id string, turn int, type string, name string, properties map<string,string>"), "turn").first()
    assert (again.type, again.name, again.properties) == ("y", "a", {"k": "v"})


def decided(spark, generation, line="ssh login failed CVE-2024-0001 host=a", kind=None):
    events = spark.createDataFrame([("r", generation, kind or "string", line)], "key string, generation string, kind string, line string")
    with_context = graph.contexts(incident.incidents(events.withColumns({"incident_id": F.lit("r"), "raw_events": F.array("line")}))).select("key", "generation", "kind", graph.context_struct().alias("context"))
    return gate.process(with_context, "key", 2025, kind="kind", context="context").first()


def test_gate(spark):
    good = decided(spark, json.dumps({"Action": "Capture `tcpdump -i eth0` for CVE-2024-0001", "Explanation": "T1190 evidence. Rollback: none."}))
    assert good.accepted and not good.blocked_actions
    bad = decided(spark, json.dumps({"Action": "Delete `rm -rf / ` now"}))
    assert not bad.accepted and {f.category for f in bad.findings} >= {"policy_constraint"}
    cves = decided(spark, json.dumps({"Action": "CVE-2999-1234 and CVE-12-12345"}))
    assert [f.message for f in cves.findings][:2] == [dims.MESSAGES["malformed_cve"], dims.MESSAGES["cve_year"]]
    assert decided(spark, "[]").accepted and decided(spark, "[]").summary.startswith("Post-processing accepted: 0 action(s)")
    one = '{"actions": [{"text": "Block a"}, {"text": "Block b"}]}'
    assert len(decided(spark, one).actions) == 2 and len(decided(spark, one, kind="object").actions) == 1


def test_records_and_shell():
    assert first_object('{not} x {"A": 1} y') == {"A": 1}
    item = generation_items('{"action": null, "response": "x"}', "string")[0]
    assert item["source_action"] == ""
    assert shell_head("sudo -u x cmd") == (None, "-u") and shell_head("grep 'x")[0] == "No closing quotation" and shell_head("a\\")[0] == "No escaped character"
    assert [r["generation"] for r in document_records('{"response": "a"}\n{"actions": ["b"], "id": 3}')] == ["a", '["b"]']
    assert document_records('{"records": [{"x": 1}]}')[0]["problem"]
    assert [i["kind"] for i in document_items('[{"a": 1}, "t"]')] == ["object", "item"] and len(document_items("a\n\nb")) == 2


def test_rates_and_pairing(spark):
    rows = spark.createDataFrame([(k, g) for k, g in enumerate(['{"Action": "Run `tcpdump -i any` T1021"}', '{"Action": "`rm -rf / ` CVE-2999-0001"}', '{"Action": "`frobnicate x`"}'])], "record_index long, generation string")
    report = evaluation.report(rows, evaluation.evaluate_actions(rows, 2025)).first()
    assert (report.record_count, report.action_count, report.command_count) == (3, 3, 3)
    assert [report[r] for r in evaluation.RATES] == pytest.approx([1 / 3] * 3)
    none = evaluation.report(rows.limit(0), evaluation.evaluate_actions(rows.limit(0), 2025)).first()
    assert none.record_count == 0 and none.hallucinated_action_rate == 0.0
    same = evaluation.compare_models(rows, rows, 2025).where("metric = 'unsafe_action_rate'").first()
    assert same.relative_reduction == 0.0
    with pytest.raises(ValueError, match="same number"):
        evaluation.validate_paired(rows, rows.limit(2))
    with pytest.raises(ValueError, match="not paired"):
        evaluation.validate_paired(rows.withColumn("id", F.lit("a")), rows.withColumn("id", F.lit("b")))


def test_split_follows_the_seeded_shuffle(spark):
    rows = spark.range(10).select(F.col("id").alias("source_index"))
    order = list(range(10))
    random.Random(7).shuffle(order)
    test = {r[0] for r in training.with_split(rows, 0.3, 7).where("split = 'test'").collect()}
    assert test == set(order[:3])
    assert Counter(r.split for r in training.with_split(rows, 0.25, 7, exact=False).collect()) == {"test": 2, "train": 8}
    for ratio in (0.0, 1.0, -0.1, 1.1):
        with pytest.raises(ValueError, match="test_ratio"):
            training.with_split(rows, ratio)


def test_corpus_files(spark, tmp_path):
    for k, doc in enumerate([{"instructions": [["a", "b"]], "answers": [["c", "d"]]}, {"instructions": ["a", "b"], "answers": ["c", "d"]}, [{"instruction": "a", "answer": "c"}, {"instruction": "b", "answer": "d"}]]):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(doc))
        assert [tuple(r) for r in readers.training_json(spark, str(path)).orderBy("source_index").collect()] == [(0, "a", "c"), (1, "b", "d")]
    with pytest.raises(FileNotFoundError):
        readers.training_json(spark, str(tmp_path / "none.json"))
    rows = spark.createDataFrame([(k, f"ssh host=h{k}", "x") for k in range(8)], "source_index long, instruction string, answer string")
    counts = writers.aligned_splits(training.with_split(rows, 0.25, 11), training.require_valid(training.enrich(rows)), str(tmp_path / "s"))
    assert counts == {"original_test": 2, "original_train": 6, "enriched_test": 2, "enriched_train": 6}
    (tmp_path / "e.jsonl").write_text('{"generation": {"a": 1}, "id": "x"}\n{"response": "t", "kg_context": {"incident": {"cves": ["CVE-2024-1"]}}}\n')
    got = readers.evaluation_records(spark, str(tmp_path / "e.jsonl")).orderBy("record_index").collect()
    assert [r.kind for r in got] == ["object", "string"] and got[1].context.incident.cves == ["CVE-2024-1"]


HEAVY = {"kg_shared_neighbors", "gate_summary", "eval_details", "kg_edges", "asset_inventory", "service_counts"}


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - HEAVY))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    made, want = QUERIES[name](spark, SMALL), con.execute(ORACLE_SQL[name])
    columns = sorted(made.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in made.collect())
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert ours == theirs
