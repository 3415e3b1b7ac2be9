"""The queries of the incident engine, each over its whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import dims
from emberlog.operators import actions, evaluation, gate, graph, incident, training
from emberlog.plans import oracle, views
from emberlog.runtime import exploded, materialize, once_each, scratch_path, spread
from emberlog.sources import readers, writers

YEAR = oracle.YEAR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident.parse_lines(views.view(spark, sf_dir, views.LOG_LINES))


def count(name: str = "n") -> F.Column:
    return F.count("*").alias(name)


# Extraction -----------------------------------------------------------------------------------

def _ioc_counts(df: DataFrame, text: str, by: str) -> DataFrame:
    found = exploded(incident.with_iocs(df.select(by, F.coalesce(text, F.lit("")).alias("text"))), "iocs", "i", by)
    return found.groupBy(by, F.col("i.type").alias("type")).agg(count(), F.count_distinct("i.value").alias("n_values"))


@query("WITH texts AS (SELECT doc_id AS incident_id, lang AS summary, coalesce(text, '') AS text FROM documents), " + oracle.INCIDENTS + " SELECT summary AS lang, v.type AS type, count(*) AS n, count(DISTINCT v.value) AS n_values FROM (SELECT summary, unnest(iocs) AS v FROM inc) x GROUP BY ALL")
def ioc_extract_documents(spark, sf_dir):
    """Indicators of whole documents, by language and type (EXT1, EXT2)."""
    return _ioc_counts(spread(table(spark, sf_dir, "documents")), "text", "lang")


@query("WITH texts AS (SELECT page_id AS incident_id, '' AS summary, coalesce(url, '') AS text FROM pages), " + oracle.INCIDENTS + " SELECT incident_id AS page_id, v.type AS type, v.value AS value FROM (SELECT incident_id, unnest(iocs) AS v FROM inc) x")
def ioc_extract_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("text"))
    return exploded(incident.with_iocs(pages), "iocs", "i", "page_id").select("page_id", "i.type", "i.value")


@query(oracle.LOGS + " SELECT incident_id, summary, severity, array_to_string(list_transform(iocs, lambda v: v.type || '=' || v.value), ' ') AS iocs, array_to_string(cves, ' ') AS cves, array_to_string(assets, ' ') AS assets, array_to_string(services, ' ') AS services, array_to_string(stages, ' ') AS stages, 'log_parser' AS source FROM inc")
def incident_parse(spark, sf_dir):
    """Whole incidents from log lines (EXT1 to EXT8), their lists in order."""
    pairs = F.transform("iocs", lambda v: F.concat(v["type"], F.lit("="), v["value"]))
    return log_incidents(spark, sf_dir).select("incident_id", "summary", "severity", F.array_join(pairs, " ").alias("iocs"), *[F.array_join(c, " ").alias(c) for c in ("cves", "assets", "services")], F.array_join("attack_stages", " ").alias("stages"), "source")


@query(oracle.LOGS + " SELECT severity, count(*) AS n FROM inc GROUP BY severity")
def severity_distribution(spark, sf_dir):
    return log_incidents(spark, sf_dir).groupBy("severity").agg(count())


def _inventory(spark, sf_dir, column: str, name: str) -> DataFrame:
    return exploded(log_incidents(spark, sf_dir), column, name).groupBy(name).agg(count())


for _name, _column, _list in (("stage_counts", "attack_stages", "stages"), ("service_counts", "services", "services"), ("asset_inventory", "assets", "assets"), ("cve_inventory", "cves", "cves")):
    QUERIES[_name] = lambda spark, sf_dir, c=_column: _inventory(spark, sf_dir, c, "name")
    ORACLE_SQL[_name] = oracle.LOGS + f" SELECT name, count(*) AS n FROM (SELECT unnest({_list}) AS name FROM inc) x GROUP BY name"


@query("WITH texts AS (SELECT doc_id AS incident_id, lang AS summary, coalesce(text, '') AS text FROM documents), " + oracle.INCIDENTS + " SELECT summary AS lang, severity, count(*) AS n, cast(sum(len(services)) AS bigint) AS n_services, cast(sum(len(stages)) AS bigint) AS n_stages FROM inc GROUP BY ALL")
def document_severity(spark, sf_dir):
    """Keyword classification of whole documents (EXT5 to EXT7)."""
    docs = spread(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    found = docs.select("lang", F.lower(text).alias("low"), incident.extract_cves(text).alias("cves"))
    found = found.withColumns({"services": incident.infer_services(F.col("low")), "stages": incident.infer_stages(F.col("low"))})
    told = found.select("lang", incident.infer_severity(F.col("low"), F.col("cves"), F.col("stages")).alias("severity"), F.size("services").alias("a"), F.size("stages").alias("b"))
    return told.groupBy("lang", "severity").agg(count(), F.sum("a").alias("n_services"), F.sum("b").alias("n_stages"))


# Graph ----------------------------------------------------------------------------------------


def _flat_nodes(nodes: DataFrame) -> DataFrame:
    props = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return nodes.withColumn("properties", props)


@query(oracle.LOGS + oracle.GRAPH + " SELECT graph_id, id, type, name, properties FROM nodes")
def kg_nodes(spark, sf_dir):
    return _flat_nodes(graph.node_table(graph.with_graph(log_incidents(spark, sf_dir))))


@query(oracle.LOGS + oracle.GRAPH + " SELECT graph_id, source, relation, target FROM edges")
def kg_edges(spark, sf_dir):
    return graph.edge_table(graph.with_graph(log_incidents(spark, sf_dir)))


@query(oracle.LOGS + oracle.GRAPH + " SELECT depth, graph_id, (SELECT count(*) FROM nodes n WHERE n.graph_id = g.graph_id AND lv <= depth) AS n_nodes, (SELECT count(*) FROM edges e WHERE e.graph_id = g.graph_id AND lv <= depth) AS n_edges FROM n_of g, (VALUES (0), (1), (2), (3)) AS d(depth)")
def kg_depths(spark, sf_dir):
    """Sizes of the retrieved context at depths 0 to 3 (KG4 in closed form)."""
    rows = log_incidents(spark, sf_dir)
    sizes = [F.struct(F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges")).alias(f"at_{d}") for d in range(graph.LEVELS + 1)]
    for d, size in enumerate(sizes):
        rows = graph.with_graph(rows, d).select("*", size).drop("nodes", "edges")
    each = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"at_{min(d, graph.LEVELS)}").alias("n")) for d in range(4)])
    found = rows.select(F.col("incident_id").alias("graph_id"), F.explode_outer(each).alias("x"))
    return found.select("x.depth", "graph_id", "x.n.n_nodes", "x.n.n_edges")


@query(
    oracle.LOGS.replace("WITH ", "WITH RECURSIVE ", 1) + oracle.GRAPH + """, shared AS (SELECT DISTINCT source, relation, target FROM edges),
both_ways AS (SELECT source AS a, target AS b FROM shared UNION SELECT target, source FROM shared), seeds AS (SELECT DISTINCT id FROM nodes WHERE type = 'asset' AND name LIKE 'web-%'),
walk AS (SELECT id, 0 AS d FROM seeds UNION SELECT b, d + 1 FROM walk JOIN both_ways ON a = id WHERE d < 2),
near AS (SELECT id, min(d) AS d FROM walk GROUP BY id)
SELECT 'node' AS what, id AS source, '' AS relation, '' AS target FROM near UNION ALL
SELECT 'edge', source, relation, target FROM shared WHERE source IN (SELECT id FROM near WHERE d < 2) OR target IN (SELECT id FROM near WHERE d < 2)"""
)
def kg_shared_neighbors(spark, sf_dir):
    """Breadth-first retrieval in the graph that all incidents share, from its web assets (KG4, JN7)."""
    found = materialize(graph.with_graph(log_incidents(spark, sf_dir)).select("incident_id", "nodes", "edges"), "graphs")
    nodes = graph.node_table(found)
    edges = materialize(graph.shared_edges(found), "edges")
    seeds = nodes.where("type = 'asset' and name like 'web-%'").select("id")
    near, picked = graph.neighbors(nodes.select("id").distinct(), edges, seeds, 2)
    return near.select(F.lit("node").alias("what"), F.col("id").alias("source"), F.lit("").alias("relation"), F.lit("").alias("target")).unionByName(picked.select(F.lit("edge").alias("what"), "source", "relation", "target"))


@query("SELECT concat('asset:', o_custkey) AS id, arg_max(o_orderstatus, o_orderkey) AS type, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN concat('asset:', o_custkey) ELSE concat('name-', o_orderkey) END, o_orderkey) AS name, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey")
def kg_upsert(spark, sf_dir):
    """Nodes written many times: the last write of an id stays, a missing name is the id (KG1)."""
    orders = table(spark, sf_dir, "orders")
    written = orders.select(F.concat(F.lit("asset:"), "o_custkey").alias("id"), F.col("o_orderkey").alias("turn"), F.col("o_orderstatus").alias("type"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("name-"), "o_orderkey")).alias("name"), F.create_map(F.lit("priority"), "o_orderpriority").alias("properties"))
    return graph.upsert_nodes(written, "turn").select("id", "type", "name", F.col("properties")["priority"].alias("priority"))


@query("SELECT DISTINCT concat('c', o_custkey) AS source, o_orderstatus AS relation, concat('c', o_orderkey) AS target FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AND o_orderkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def kg_valid_edges(spark, sf_dir):
    """Edges with an end that is no node are dropped, repeats collapse (KG2, JN6)."""
    nodes = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    edges = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.col("o_orderstatus").alias("relation"), F.concat(F.lit("c"), "o_orderkey").alias("target"))
    return graph.valid_edges(edges, nodes)


@query(oracle.LOGS + oracle.GRAPH + " SELECT severity, name AS recommendation, count(*) AS n FROM nodes JOIN inc ON incident_id = graph_id WHERE type IN ('mitigation', 'security_rule') GROUP BY ALL")
def recommendations_by_severity(spark, sf_dir):
    found = graph.contexts(log_incidents(spark, sf_dir))
    return exploded(found, "recommendations", "recommendation", "severity").groupBy("severity", "recommendation").agg(count())


@query(oracle.LOGS + oracle.GRAPH + " SELECT incident_id, advice AS recommendations, prompt_context FROM ctx")
def kg_prompt_context(spark, sf_dir):
    """Recommendations in node order, and the prompt text (KG5 to KG8)."""
    return graph.contexts(log_incidents(spark, sf_dir)).select("incident_id", F.array_join("recommendations", "; ").alias("recommendations"), "prompt_context")


# Actions, gate, evaluation --------------------------------------------------------------------


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, views.GENERATIONS)


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations with what the context of their own log line tells the gate; equal lines have one context."""

    def told(lines: DataFrame) -> DataFrame:
        found = graph.contexts(incident.incidents(lines.withColumns({"incident_id": F.col("line"), "raw_events": F.array("line")})))
        return found.select(*lines.columns, gate.known(graph.context_struct()).alias("known"))

    return once_each(generations(spark, sf_dir), ["line"], told).drop("line")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate_actions(grounded(spark, sf_dir), YEAR, ground="known")


@query(oracle.PARSED + " SELECT model, record_index, action_index, action_type, array_to_string(targets, '|') AS target, array_to_string(commands, '|') AS command, precondition, risk, rollback, array_to_string(evidence, '|') AS evidence, source_action, source_explanation FROM acts")
def action_parse(spark, sf_dir):
    """All fields of all actions (ACT1 to ACT10)."""
    at = F.col("action")
    found = actions.parse_actions(generations(spark, sf_dir))
    return found.select("model", "record_index", "action_index", *[(F.array_join(at[c], "|") if c in ("target", "command", "evidence") else at[c]).alias(c) for c in actions.ACTION_FIELDS])


@query(oracle.PARSED + " SELECT model, action_type, count(*) AS n, cast(sum(len(commands)) AS bigint) AS n_commands, cast(sum(len(targets)) AS bigint) AS n_targets FROM acts GROUP BY ALL")
def action_type_distribution(spark, sf_dir):
    found = actions.parse_actions(generations(spark, sf_dir)).select("model", "action.*")
    return found.groupBy("model", "action_type").agg(count(), F.sum(F.size("command")).alias("n_commands"), F.sum(F.size("target")).alias("n_targets"))


@query(oracle.GATE + " SELECT model, record_index, action_index, f.category AS category, f.severity AS severity, f.message AS message, f.evidence AS evidence FROM (SELECT model, record_index, action_index, unnest(findings) AS f FROM judged) x")
def gate_findings(spark, sf_dir):
    """Every finding of every action (GATE1 to GATE9)."""
    found = gate.validate(grounded(spark, sf_dir), YEAR, ground="known")
    return exploded(found, "findings", "f", "model", "record_index", "action_index").select("model", "record_index", "action_index", "f.*")


_PROCESSED = """
SELECT v.model, v.record_index, coalesce(bool_and(accepted), true) AS accepted, count(accepted) AS n_actions, cast(coalesce(count_if(NOT accepted), 0) AS bigint) AS n_blocked,
  'Post-processing ' || CASE WHEN coalesce(bool_and(accepted), true) THEN 'accepted' ELSE 'blocked' END || ': ' || count(accepted) || ' action(s), ' || coalesce(count_if(NOT accepted), 0) || ' blocked, '
  || coalesce(sum(len(list_filter(findings, lambda f: f.severity = 'error'))), 0) || ' error(s), ' || coalesce(sum(len(list_filter(findings, lambda f: f.severity = 'warning'))), 0) || ' warning(s).' AS summary
FROM (SELECT model, record_index FROM gens) v LEFT JOIN marked m ON m.model = v.model AND m.record_index = v.record_index GROUP BY v.model, v.record_index"""


@query(oracle.GATE + _PROCESSED)
def gate_decisions(spark, sf_dir):
    """The gate's decision on every generation (GATE10 to GATE13)."""
    rows = grounded(spark, sf_dir).withColumn("key", F.struct("model", "record_index"))
    found = gate.process(rows, "key", YEAR, ground="known")
    n = F.size("actions") + F.size("blocked_actions")
    return found.select("key.model", "key.record_index", "accepted", n.cast("long").alias("n_actions"), F.size("blocked_actions").cast("long").alias("n_blocked"), "summary")


@query(oracle.GATE + " SELECT model, f.category AS category, f.severity AS severity, f.message AS message, count(*) AS n FROM (SELECT model, unnest(findings) AS f FROM judged) x GROUP BY ALL")
def gate_summary(spark, sf_dir):
    found = exploded(gate.validate(grounded(spark, sf_dir), YEAR, ground="known"), "findings", "f", "model")
    return found.select("model", "f.category", "f.severity", "f.message").groupBy("model", "category", "severity", "message").agg(count())


@query(oracle.GATE + " SELECT model, record_index, action_index, hallucinated, unsafe, command_count, incorrect_command_count, accepted FROM marked")
def eval_details(spark, sf_dir):
    return judged(spark, sf_dir).select("model", "record_index", "action_index", "hallucinated", "unsafe", "command_count", "incorrect_command_count", "accepted")


@query(oracle.GATE + " SELECT * FROM rates")
def eval_rates(spark, sf_dir):
    """Error rates of each model (AGG1 to AGG9)."""
    return evaluation.report(generations(spark, sf_dir).select("model"), judged(spark, sf_dir), ("model",))


_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, model, record_count, {m} AS rate FROM rates" for m in evaluation.RATES)


@query(
    oracle.GATE + f""", long AS ({_LONG}), sides AS (SELECT metric, max(CASE WHEN model = 'baseline' THEN rate END) AS b, max(CASE WHEN model = 'candidate' THEN rate END) AS c, max(record_count) AS n FROM long GROUP BY metric)
SELECT 'baseline' AS baseline_name, 'candidate' AS candidate_name, n AS paired_record_count, metric, b AS baseline_rate, c AS candidate_rate, c - b AS absolute_change, b - c AS absolute_improvement, CASE WHEN b <> 0 THEN (b - c) / b END AS relative_reduction FROM sides"""
)
def model_comparison(spark, sf_dir):
    """Both models over the same prompts: pairing is checked, then rates are compared (AGG11, AGG12, JN8, JN9)."""
    rows = grounded(spark, sf_dir)
    baseline, candidate = (rows.where(F.col("model") == m).drop("model") for m in ("baseline", "candidate"))
    return evaluation.compare_models(baseline, candidate, YEAR, ground="known")


@query(
    """WITH b AS (SELECT o_orderkey AS record_index, concat('r', o_orderkey) AS id FROM orders WHERE o_orderkey % 7 <> 1),
c AS (SELECT o_orderkey AS record_index, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'other' ELSE concat('r', o_orderkey) END AS id FROM orders WHERE o_orderkey % 13 <> 2)
SELECT coalesce(b.record_index, c.record_index) AS record_index, b.id AS baseline_id, c.id AS candidate_id, CASE WHEN b.record_index IS NULL OR c.record_index IS NULL THEN 'unpaired' ELSE 'id_mismatch' END AS violation
FROM b FULL JOIN c ON b.record_index = c.record_index WHERE b.record_index IS NULL OR c.record_index IS NULL OR b.id <> c.id"""
)
def pairing_violations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_index"))
    name = F.concat(F.lit("r"), "record_index")
    baseline = orders.where("record_index % 7 <> 1").withColumn("id", name)
    candidate = orders.where("record_index % 13 <> 2").withColumn("id", F.when(F.col("record_index") % 5 == 0, None).when(F.col("record_index") % 11 == 0, "other").otherwise(name))
    return evaluation.pairing_violations(baseline, candidate)


# Training corpus ------------------------------------------------------------------------------


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, views.EXAMPLES)


@query(oracle.EXAMPLE_CONTEXTS + " SELECT cast(substr(incident_id, 9) AS bigint) AS source_index, true AS ok, 0 AS n_errors, len(iocs) AS iocs, len(cves) AS cves, len(assets) AS assets, len(services) AS services, len(stages) AS attack_stages, n_nodes AS nodes, n_edges AS edges FROM ctx")
def enrichment_validation(spark, sf_dir):
    """Validation of every enriched example (ENR1 to ENR5)."""
    v = F.col("metadata.validation")
    found = training.enrich(examples(spark, sf_dir))
    return found.select("source_index", v["ok"].alias("ok"), F.size(v["errors"]).alias("n_errors"), *[v["incident_counts"][c].alias(c) for c in training.COUNTED], v["kg_counts"]["nodes"].alias("nodes"), v["kg_counts"]["edges"].alias("edges"))


_TEXTS = lambda c: f"CASE WHEN len({c}) = 0 THEN '[]' ELSE concat('[', chr(10), '    ', array_to_string(list_transform({c}, lambda v: cast(to_json(v) AS varchar)), concat(',', chr(10), '    ')), chr(10), '  ]') END"
_IOCS = "CASE WHEN len(iocs) = 0 THEN '[]' ELSE concat('[', chr(10), '    ', array_to_string(list_transform(iocs, lambda v: concat('{', chr(10), '      \"type\": ', cast(to_json(v.type) AS varchar), ',', chr(10), '      \"value\": ', cast(to_json(v.value) AS varchar), chr(10), '    }')), concat(',', chr(10), '    ')), chr(10), '  ]') END"
_MEMBERS = (
    ("incident_id", "cast(to_json(incident_id) AS varchar)"), ("observed_at", "'\"\"'"), ("summary", "cast(to_json(summary) AS varchar)"), ("iocs", _IOCS), ("cves", _TEXTS("cves")), ("assets", _TEXTS("assets")), ("services", _TEXTS("services")),
    ("attack_stages", _TEXTS("stages")), ("severity", "cast(to_json(severity) AS varchar)"), ("source", "'\"log_parser\"'"), ("raw_events", _TEXTS("CASE WHEN text = '' THEN [] ELSE [text] END")),
)
_DOCUMENT = "concat('{', chr(10), " + ", ',', chr(10), ".join(f"'  \"{name}\": ', {value}" for name, value in _MEMBERS) + ", chr(10), '}')"
_ENRICHED_SQL = f" SELECT source_index, answer, trim(instruction) || chr(10) || chr(10) || {oracle.q(dims.ENRICHMENT_PREAMBLE)} || chr(10) || '<incident_json>' || chr(10) || {_DOCUMENT} || chr(10) || '</incident_json>' || chr(10) || '<kg_rag_context>' || chr(10) || prompt_context || chr(10) || '</kg_rag_context>' AS instruction FROM ctx JOIN ({views.plain(views.EXAMPLES)}) x ON incident_id = printf('example-%06d', source_index)"


@query(oracle.EXAMPLE_CONTEXTS + _ENRICHED_SQL)
def enriched_instructions(spark, sf_dir):
    """The whole enriched instruction, with the incident as a JSON document in it (ENR3)."""
    return training.enrich(examples(spark, sf_dir)).select("source_index", "answer", "instruction")


@query()
def paired_split(spark, sf_dir):
    """The seeded shuffle of one process: no SQL has it; tests hold it against random.Random (SPL1)."""
    return training.with_split(examples(spark, sf_dir)).select("source_index", "split")


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'test' AS split, cast(round_even(n * 0.2, 0) AS bigint) AS n FROM n UNION ALL SELECT 'train', n - cast(round_even(n * 0.2, 0) AS bigint) FROM n")
def split_sizes(spark, sf_dir):
    """The parallel split: exact sizes for any number of rows."""
    return training.with_split(examples(spark, sf_dir), exact=False).groupBy("split").agg(count())


_STUB = "'{\"Action\": \"Isolate host web-1 and preserve logs.\", \"Explanation\": \"' || length(instruction) || ' characters were read.\"}'"


@query(f"SELECT cast(source_index AS varchar) AS id, 'stub' AS model_name_or_path, instruction, answer AS expected_answer, {_STUB} AS generation, true AS post_processing_enabled, true AS accepted, 'Post-processing accepted: 1 action(s), 0 blocked, 0 error(s), 0 warning(s).' AS summary FROM ({views.plain(views.EXAMPLES)}) x")
def predictions(spark, sf_dir):
    """Prediction records with a stub in the place of the model (UDF1, UDF4)."""
    stub = lambda text: '{"Action": "Isolate host web-1 and preserve logs.", "Explanation": "' + str(len(text)) + ' characters were read."}'
    made = training.predictions(examples(spark, sf_dir), stub, "stub", YEAR)
    return made.select("id", "model_name_or_path", "instruction", "expected_answer", "generation", "post_processing_enabled", "post_processing.accepted", "post_processing.summary")


# Files ----------------------------------------------------------------------------------------


@query(f"SELECT trim(line) AS line, count(*) AS n FROM ({views.plain(views.LOG_LINES)}) l WHERE trim(line) <> '' GROUP BY ALL")
def io_text_lines(spark, sf_dir):
    """Lines written as text and read back (SRC1)."""
    path = scratch_path(spark, "lines")
    views.view(spark, sf_dir, views.LOG_LINES).select("line").write.text(path)
    return readers.text_lines(spark, path, "all").select(F.trim("line").alias("line")).where("line <> ''").groupBy("line").agg(count())


@query(f"SELECT record_index, record_id, generation, 'string' AS kind FROM ({views.plain(views.GENERATIONS)}) v WHERE model = 'candidate'")
def io_evaluation_lines(spark, sf_dir):
    """Evaluation records as JSON lines and back, types kept (SRC5, SNK5)."""
    path = scratch_path(spark, "records")
    writers.json_lines(generations(spark, sf_dir).where("model = 'candidate'").select("record_index", "record_id", "generation"), path)
    return readers.evaluation_lines(spark, path, "record_index").drop("context")


@query(views.plain(views.EXAMPLES))
def io_corpus_document(spark, sf_dir):
    """The corpus as one nested document and back (SRC6, SNK2)."""
    path = scratch_path(spark, "corpus")
    writers.corpus_document(examples(spark, sf_dir), path)
    return readers.training_json(spark, path)


@query(oracle.LOGS + " SELECT incident_id, '' AS observed_at, summary, severity, 'log_parser' AS source, array_to_string(list_transform(iocs, lambda x: x.type || '=' || x.value), ' ') AS iocs, array_to_string(cves, ' ') AS cves, array_to_string(assets, ' ') AS assets, array_to_string(services, ' ') AS services, array_to_string(stages, ' ') AS attack_stages FROM inc")
def io_incident_json(spark, sf_dir):
    """Incidents as JSON lines and back through their reader, which fills what is missing (SRC3, SNK1)."""
    path = scratch_path(spark, "incidents")
    writers.json_lines(log_incidents(spark, sf_dir).withColumn("observed_at", F.lit(None).cast("string")), path)
    found = readers.incident_json(spark, path, lines=True)
    iocs = F.array_join(F.transform("iocs", lambda x: F.concat(x["type"], F.lit("="), x["value"])), " ").alias("iocs")
    return found.select("incident_id", "observed_at", "summary", "severity", "source", iocs, *[F.array_join(c, " ").alias(c) for c in ("cves", "assets", "services", "attack_stages")])
