"""What keeps the cost of large tables in proportion: rows dealt evenly, repeats computed once, results the same either way."""

import json
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog import runtime
from emberlog.functions import dims
from emberlog.functions.textfx import java, strip
from emberlog.operators import actions, gate, graph, incident
from emberlog.plans import views
from emberlog.sources import readers, writers

TEXTS = ['{"Action": "Delete `rm -rf / ` now", "Explanation": "CVE-2999-1234"}', "[]", None, "", "Block host a. Restore later; if risk grows, escalate.", '[{"action": "x", "command": "grep \'y"}, {"text": "z"}]']


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    spark.range(40_000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = views.view(spark, str(tmp_path), views.EXAMPLES).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sum(r["count"] for r in rows) == 40_000 and max(r["count"] for r in rows) <= 10_000


@pytest.mark.parametrize("times", [1, 5])
def test_repeats_are_made_once_and_give_the_same_rows(spark, times):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * times)], "k long, generation string")
    calls = []

    def make(df):
        calls.append(df.columns)
        return actions.actions_of_rows(df)

    found = Counter(map(str, runtime.once_each(rows, ["generation"], make).collect()))
    assert found == Counter(map(str, actions.actions_of_rows(rows).collect())) and sum(found.values()) == 6 * times
    assert calls == [["k", "generation"] if times == 1 else ["generation"]]


def test_verdicts_do_not_depend_on_repeats(spark, monkeypatch):
    ground = "struct<cves:array<string>,techniques:array<string>,stages:array<string>>"
    rows = [(k, t, None if k % 2 else (["CVE-2024-1"], [], ["execution"])) for k, t in enumerate(TEXTS * 5)]
    frame = spark.createDataFrame(rows, f"key long, generation string, ground {ground}")
    got = []
    for least in (4, 1e9):
        monkeypatch.setattr(runtime, "REPEATS", least)
        got.append(sorted(str(r) for r in gate.process(frame, "key", 2025, ground="ground").collect()))
        got.append(sorted(str(r) for r in gate.validate(frame, 2025, ground="ground").collect()))
    assert got[:2] == got[2:] and len(got[0]) == len(rows)


def test_boundaries_in_front_of_patterns(spark):
    texts = ["_rm -rf / é", "ſudo rm -rf /", "érm -rf /x", "-a.bc a-.de .x@y.zz", "٣1.2.3.4 1.2.3.4", "Kill -9 1", "host=a xhost=b́ HOſT: c", "t1059 T1059.001x CVE-2023-12 x-cve-23-12345", "SERVICE restart rm x", "a" * 40]
    patterns = [(p, False) for p in (*dims.IOC_PATTERNS.values(), *dims.TARGET_PATTERNS)] + [(p, True) for p in (*dims.ASSET_PATTERNS, dims.CVE_PATTERN, dims.MALFORMED_CVE_PATTERN, dims.TECHNIQUE_PATTERN, dims.COMMAND_PATTERN, *[x for x, _ in dims.HIGH_RISK_PATTERNS])]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    made = frame.select("t", *[F.regexp_extract_all("t", F.lit(java(p, i)), F.lit(0)).alias(f"p{k}") for k, (p, i) in enumerate(patterns)]).collect()
    for row in made:
        assert [row[f"p{k}"] for k in range(len(patterns))] == [[m[0] for m in re.finditer(p, row.t, re.I if i else 0)] for p, i in patterns]
    odd = [f"{c}x {c}y{c}" for c in map(chr, [9, 11, 28, 32, 133, 160, 5760, 8203, 8232, 12288, 65279])] + ["", " \n"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(strip(F.col("t"))).collect()] == [t.strip() for t in odd]


def test_flat_items_with_names_that_differ_in_case(spark):
    texts = ['{"Command": "a", "ACTION": "b"}', '{"action": "a", "Action": "b"}', '{"Risk": " r ", "revert": null, "targets": "x"}']
    rows = spark.createDataFrame([(json.dumps(k), t) for k, t in enumerate(texts)], "k string, generation string")
    got = {r.k: r["items"][0] for r in actions.with_items(rows).collect()}
    assert (got["0"].source_action, got["0"].command) == ("b", "a") and got["1"].source_action == "b" and (got["2"].risk, got["2"].rollback, got["2"].target) == ("r", "", "x")


def test_edges_of_a_large_incident_are_not_compared_pair_by_pair(spark):
    n = 60_000
    texts = lambda kind: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit(kind), (k % (n - 1)).cast("string")))
    none = F.array().cast("array<string>")
    iocs = F.transform(texts("d"), lambda v: F.struct(F.lit("domain").alias("type"), v.alias("value")))
    rows = spark.range(1).select(F.lit("i").alias("incident_id"), F.lit("s").alias("summary"), F.lit("low").alias("severity"), texts("CVE-").alias("cves"), none.alias("assets"), none.alias("services"), iocs.alias("iocs"), none.alias("attack_stages"))
    began = time.time()
    row = graph.with_graph(rows).first()
    assert time.time() - began < 20  # 7 billion comparisons otherwise
    edges = [tuple(e) for e in row.edges]
    assert len(row.nodes) == 2 * (n - 1) + 1 and len(edges) == 2 * (n - 1) and edges == sorted(set(edges)) and [x.id for x in row.nodes] == sorted(x.id for x in row.nodes)


def test_edges_that_graphs_share_stand_once(spark):
    lines = [(f"i{k}", 0, "exploit CVE-2023-1111 host=m-01 http service exfil upload") for k in range(3)]
    found = graph.with_graph(incident.parse_lines(spark.createDataFrame(lines, "incident_id string, line_no int, line string")))
    every = Counter(tuple(r) for r in graph.shared_edges(found).collect())
    assert set(every.values()) == {1} and set(every) == {tuple(r) for r in graph.edge_table(found).drop("graph_id").collect()}


def test_corpus_document_is_written_and_read_in_parts(spark, tmp_path):
    texts = ["plain", 'q"\\\n\r\t\x01é😀 \x85', "", ",,lead", None, "]]}", '{"instructions": [[', "null", " x "]
    rows = [(k * 2, texts[k % len(texts)], texts[(k + 1) % len(texts)], (k, texts[k % 3])) for k in range(300)]
    frame = spark.createDataFrame(rows, "source_index long, instruction string, answer string, metadata struct<n:long,t:string>").repartition(7)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for columns in (["source_index", "instruction", "answer", "metadata"], ["source_index", "instruction", "answer"]):
        writers.corpus_document(frame.select(*columns), str(tmp_path / "c"))
        made = json.loads((tmp_path / "c" / "document.json").read_text(encoding="utf-8"))
        assert made["instructions"] == [[r[1] for r in rows]] and made["answers"] == [[r[2] for r in rows]]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        try:
            found = readers.training_json(spark, str(tmp_path / "c"))
            assert sorted(map(tuple, found.select("source_index", "instruction", "answer").collect())) == [(k, r[1], r[2]) for k, r in enumerate(rows)]
            if "metadata" in columns:
                assert {r.source_index: (r.metadata.n, r.metadata.t) for r in found.collect()} == {k: r[3] for k, r in enumerate(rows)}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert readers.training_json(spark, str(tmp_path / "c"), 3).count() == 3
    writers.corpus_document(frame.limit(0), str(tmp_path / "none"))
    assert readers.training_json(spark, str(tmp_path / "none")).count() == 0
