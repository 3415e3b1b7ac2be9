"""DuckDB SQL for the queries, written on its own: lists, lambdas, JSON functions, RE2 patterns."""

from __future__ import annotations

from emberlog.functions import dims
from emberlog.plans.views import EXAMPLES, GENERATIONS, LOG_LINES, plain

YEAR = 2025


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(text: str, pattern: str, group: int = 0, ignore_case: bool = False) -> str:
    flag = "(?i)" if ignore_case else ""
    return f"regexp_extract_all({text}, {q(flag + pattern)}, {group})"


def cleaned(values: str) -> str:
    return f"list_filter(list_transform({values}, lambda x: trim(trim(x, ' ' || chr(9) || chr(10) || chr(13)), {q(dims.TRIMMED)})), lambda x: x <> '')"


def once(values: str) -> str:
    """First occurrences, in order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def any_word(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"


def groups(low: str, table: dict) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {any_word(low, words)} THEN {q(name)} END" for name, words in table.items()) + "], lambda x: x IS NOT NULL)"


def pairs(table: dict, *names: str) -> str:
    rows = []
    for key, value in table.items():
        for v in value if isinstance(value[0], str) and len(names) == 2 else [value]:
            rows.append((key, v) if isinstance(v, str) else (key, *v))
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"


#: From texts(incident_id, summary, text) to one row for each incident.
INCIDENTS = f"""
i1 AS (SELECT *, lower(text) AS low, {", ".join(f"{cleaned(found('text', p))} AS c_{k}" for k, p in dims.IOC_PATTERNS.items())},
  {cleaned(f"list_transform({found('text', dims.CVE_PATTERN, 0, True)}, lambda x: upper(x))")} AS c_cves,
  {cleaned(f"list_concat({found('text', dims.ASSET_PATTERNS[0], 1, True)}, {found('text', dims.ASSET_PATTERNS[1], 1, True)})")} AS c_assets
  FROM texts),
i2 AS (SELECT incident_id, summary, text, low, {", ".join(f"{once('c_' + k)} AS {k}" for k in dims.IOC_PATTERNS)}, {once("c_cves")} AS cves, {once("c_assets")} AS assets,
  {groups("low", dims.SERVICE_WORDS)} AS services, {groups("low", dims.STAGE_WORDS)} AS stages FROM i1),
i3 AS (SELECT *, list_concat(list_transform(url, lambda u: lower(split_part(regexp_replace(u, '^https?://', ''), '/', 1))), list_transform(email, lambda m: lower(substr(m, strpos(m, '@') + 1)))) AS taken FROM i2),
i4 AS (SELECT *, list_filter(domain, lambda d: NOT list_contains(taken, lower(d))) AS free FROM i3),
inc AS (SELECT incident_id, summary, text, low, cves, assets, services, stages,
  list_concat({", ".join(f"list_transform({'free' if k == 'domain' else k}, lambda v: {{'type': {q(k)}, 'value': v}})" for k in dims.IOC_PATTERNS)}) AS iocs,
  CASE WHEN {any_word("low", dims.CRITICAL_WORDS)} THEN 'critical'
       WHEN len(cves) > 0 OR {" OR ".join(f"list_contains(stages, {q(s)})" for s in dims.HIGH_STAGES)} THEN 'high'
       WHEN {any_word("low", dims.MEDIUM_WORDS)} THEN 'medium' WHEN trim(text) <> '' THEN 'low' ELSE 'unknown' END AS severity
  FROM i4)
"""

_LINES = f"""
lines AS (SELECT incident_id, line_no, trim(line) AS line FROM ({plain(LOG_LINES)}) l),
texts AS (SELECT incident_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (line <> ''), '') AS text,
  coalesce(substr(arg_min(line, line_no) FILTER (line <> ''), 1, {dims.SUMMARY_CHARS}), {q(dims.NO_EVENTS)}) AS summary FROM lines GROUP BY incident_id),
"""
LOGS = "WITH " + _LINES + INCIDENTS

GRAPH = f"""
, e1 AS (SELECT incident_id AS graph_id, unnest(cves) AS v FROM inc), e2 AS (SELECT incident_id AS graph_id, unnest(assets) AS v FROM inc),
e3 AS (SELECT incident_id AS graph_id, unnest(services) AS v FROM inc), e4 AS (SELECT incident_id AS graph_id, unnest(iocs) AS v FROM inc),
e5 AS (SELECT incident_id AS graph_id, unnest(stages) AS v FROM inc),
x1 AS (SELECT e5.graph_id, v, tid, tname FROM e5 JOIN {pairs(dims.TECHNIQUES, "k", "tid", "tname")} ON k = v),
x2 AS (SELECT e5.graph_id, v, m FROM e5 JOIN {pairs(dims.MITIGATIONS, "k", "m")} ON k = v),
x3 AS (SELECT e3.graph_id, v, m FROM e3 JOIN {pairs(dims.DETECTION_RULES, "k", "m")} ON k = v),
nodes AS (
  SELECT incident_id AS graph_id, 0 AS lv, incident_id AS id, 'incident' AS type, summary AS name, 'severity=' || severity AS properties FROM inc
  UNION SELECT graph_id, 1, v, 'cve', v, '' FROM e1 UNION SELECT graph_id, 1, 'asset:' || v, 'asset', v, '' FROM e2
  UNION SELECT graph_id, 1, 'service:' || v, 'service', v, '' FROM e3 UNION SELECT graph_id, 1, 'ioc:' || v.type || ':' || v.value, 'ioc', v.value, 'ioc_type=' || v.type FROM e4
  UNION SELECT graph_id, 1, 'stage:' || v, 'attack_stage', v, '' FROM e5 UNION SELECT graph_id, 2, 'attack:' || tid, 'mitre_attack', tname, 'technique_id=' || tid FROM x1
  UNION SELECT graph_id, 2, 'mitigation:' || m, 'mitigation', m, '' FROM x2 UNION SELECT graph_id, 2, 'rule:' || m, 'security_rule', m, '' FROM x3),
edges AS (
  SELECT graph_id, 1 AS lv, graph_id AS source, 'mentions_cve' AS relation, v AS target FROM e1 UNION SELECT graph_id, 1, graph_id, 'affects_asset', 'asset:' || v FROM e2
  UNION SELECT graph_id, 1, graph_id, 'involves_service', 'service:' || v FROM e3 UNION SELECT graph_id, 1, graph_id, 'has_ioc', 'ioc:' || v.type || ':' || v.value FROM e4
  UNION SELECT graph_id, 1, graph_id, 'has_attack_stage', 'stage:' || v FROM e5 UNION SELECT graph_id, 2, 'stage:' || v, 'maps_to_attack', 'attack:' || tid FROM x1
  UNION SELECT graph_id, 2, 'stage:' || v, 'has_mitigation', 'mitigation:' || m FROM x2 UNION SELECT graph_id, 2, 'service:' || v, 'monitored_by', 'rule:' || m FROM x3),
n_of AS (SELECT graph_id, count(*) AS n_nodes, string_agg(name, ', ' ORDER BY id) FILTER (type = 'mitre_attack') AS techniques,
  string_agg(name, '; ' ORDER BY id) FILTER (type IN ('mitigation', 'security_rule')) AS advice FROM nodes GROUP BY graph_id),
e_of AS (SELECT graph_id, count(*) AS n_edges FROM edges GROUP BY graph_id),
ctx AS (SELECT inc.*, n_nodes, coalesce(n_edges, 0) AS n_edges, techniques, coalesce(advice, '') AS advice,
  concat({q(dims.PROMPT_LINES[0])}, chr(10), '- Incident: ', incident_id, ' severity=', severity, chr(10), '- Assets: ', coalesce(nullif(array_to_string(assets, ', '), ''), 'unknown'), chr(10),
    '- Services: ', coalesce(nullif(array_to_string(services, ', '), ''), 'unknown'), chr(10), '- CVEs: ', coalesce(nullif(array_to_string(cves, ', '), ''), 'none'), chr(10),
    '- MITRE ATT&CK context: ', coalesce(techniques, 'unknown'), chr(10), '- Recommended mitigations/rules: ', coalesce(advice, 'none'), chr(10),
    '- KG facts: ', n_nodes, ' nodes, ', coalesce(n_edges, 0), ' edges') AS prompt_context
  FROM inc JOIN n_of ON n_of.graph_id = incident_id LEFT JOIN e_of ON e_of.graph_id = incident_id)
"""


def _field(names) -> str:
    return "CASE " + " ".join(f"WHEN json_exists(r, '$.{n}') THEN trim(coalesce(json_extract_string(r, '$.{n}'), ''))" for n in names) + " ELSE '' END"


def _sentence(words) -> str:
    return f"coalesce(list_filter(list_transform(sentences, lambda s: trim(s)), lambda s: {any_word('lower(s)', words)})[1], '')"


def _listed(field: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({field}, {q(pattern)}), lambda x: trim(x)), lambda x: x <> '')"


_SCORES = ", ".join("(" + " + ".join(f"cast(contains(lower(body), {q(w)}) AS int)" for w in words) + f") AS s_{k}" for k, words in dims.ACTION_WORDS.items())
_BEST = "greatest(" + ", ".join(f"s_{k}" for k in dims.ACTION_WORDS) + ")"
_RAW_COMMANDS = f"list_concat({found('body', dims.QUOTED_COMMAND_PATTERN, 1)}, {found('body', dims.COMMAND_PATTERN, 0, True)})"
_RAW_TARGETS = "list_concat(" + ", ".join(found("body", p) for p in dims.TARGET_PATTERNS) + ")"

ACTIONS = f"""
gens AS (SELECT *, regexp_replace(regexp_replace(generation, '"Action":', '"action":', 'g'), '"Explanation":', '"explanation":', 'g') AS g FROM ({plain(GENERATIONS)}) v),
kinds AS (SELECT *, CASE WHEN NOT json_valid(g) THEN 'text' WHEN json_type(g) = 'ARRAY' THEN 'array' WHEN json_type(g, '$.actions') = 'ARRAY' THEN 'inner' ELSE 'text' END AS kind FROM gens),
items AS (SELECT model, record_index, line, g, unnest(CASE kind WHEN 'array' THEN cast(json_extract(g, '$[*]') AS varchar[]) WHEN 'inner' THEN cast(json_extract(g, '$.actions[*]') AS varchar[]) ELSE [g] END) AS item,
  generate_subscripts(CASE kind WHEN 'array' THEN cast(json_extract(g, '$[*]') AS varchar[]) WHEN 'inner' THEN cast(json_extract(g, '$.actions[*]') AS varchar[]) ELSE [g] END, 1) - 1 AS action_index FROM kinds),
recs AS (SELECT *, coalesce(nullif(regexp_extract(item, '(?s)\\{{.*\\}}'), ''), cast(json_object('text', item) AS varchar)) AS r FROM items),
f1 AS (SELECT model, record_index, action_index, line, r, item, {", ".join(f"{_field(n)} AS f_{k}" for k, n in dims.ITEM_FIELDS.items())} FROM recs),
f2 AS (SELECT *, coalesce(nullif(concat_ws(chr(10), nullif(f_source_action, ''), nullif(f_source_explanation, '')), ''), item) AS body FROM f1),
f3 AS (SELECT *, string_split_regex(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+') AS sentences, {_SCORES},
  list_filter(list_transform({_RAW_COMMANDS}, lambda x: trim(split_part(rtrim(trim(x), '.,;'), '`', 1))), lambda x: x <> '') AS c_commands,
  list_filter(list_transform({_RAW_TARGETS}, lambda x: rtrim(trim(x), '.,;)')), lambda x: x <> '') AS c_targets, {_listed("f_evidence", r"[,;]\s*")} AS c_evidence FROM f2),
acts AS (SELECT model, record_index, action_index, line, f_source_action AS source_action, f_source_explanation AS source_explanation,
  CASE WHEN f_action_type <> '' THEN f_action_type WHEN {_BEST} = 0 THEN 'other' {" ".join(f"WHEN s_{k} = {_BEST} THEN {q(k)}" for k in dims.ACTION_WORDS)} END AS action_type,
  CASE WHEN f_target <> '' THEN {_listed("f_target", r"[,;]\s*")} ELSE {once("c_targets")} END AS targets,
  CASE WHEN f_command <> '' THEN {_listed("f_command", r"\s*;\s*")} ELSE {once("c_commands")} END AS commands,
  CASE WHEN f_precondition <> '' THEN f_precondition ELSE {_sentence(dims.PRECONDITION_WORDS)} END AS precondition,
  CASE WHEN f_risk <> '' THEN f_risk ELSE {_sentence(dims.RISK_WORDS)} END AS risk,
  CASE WHEN f_rollback <> '' THEN f_rollback ELSE {_sentence(dims.ROLLBACK_WORDS)} END AS rollback,
  CASE WHEN len(c_evidence) > 0 THEN c_evidence ELSE list_filter([{_sentence(dims.EVIDENCE_WORDS)}], lambda x: x <> '') END AS evidence FROM f3)
"""
PARSED = "WITH " + ACTIONS

_M = {k: q(v) for k, v in dims.MESSAGES.items()}
_FINDING = "{{'category': {0}, 'severity': {1}, 'message': {2}, 'evidence': {3}}}"


def _told(category: str, severity: str, message: str, evidence: str) -> str:
    return _FINDING.format(q(category), q(severity), message, evidence)


_RISKS = ", ".join(
    f"CASE WHEN regexp_matches(joined, {q('(?i)' + p)}) THEN {_told('policy_constraint', 'error', q(dims.MESSAGES['high_risk'].format(reason=why)), f'regexp_extract(joined, {q(chr(40) + chr(63) + chr(105) + chr(41) + p)})')} END"
    for p, why in dims.HIGH_RISK_PATTERNS
)
_HEAD = "CASE WHEN split_part(c, ' ', 1) = 'sudo' AND split_part(c, ' ', 2) <> '' THEN split_part(c, ' ', 2) ELSE split_part(c, ' ', 1) END"
_DESTRUCTIVE = "action_type IN (" + ", ".join(map(q, dims.DESTRUCTIVE_TYPES)) + ")"
_KNOWN = f"list_contains([{', '.join(map(q, dims.EXECUTABLES))}], {_HEAD}) OR " + " OR ".join(f"starts_with(lower({_HEAD}), {q(p)})" for p in dims.EXECUTABLE_PREFIXES)

GATE = f"""
WITH texts AS (SELECT DISTINCT line AS incident_id, line AS summary, line AS text FROM ({plain(GENERATIONS)}) v), {INCIDENTS},
grounds AS (SELECT incident_id AS of_line, cves AS known, stages, list_filter(list_transform(stages, lambda s: map_extract(MAP {{{", ".join(f"{q(k)}: {q(v[0])}" for k, v in dims.TECHNIQUES.items())}}}, s)[1]), lambda x: x IS NOT NULL) AS paths FROM inc),
{ACTIONS},
g1 AS (SELECT acts.*, known, stages, paths, concat(source_action, chr(10), source_explanation, chr(10), array_to_string(commands, ' ')) AS said, array_to_string(commands, chr(10)) AS joined FROM acts JOIN grounds ON of_line = line),
g2 AS (SELECT *, list_sort(list_distinct({found("said", dims.MALFORMED_CVE_PATTERN, 0, True)})) AS short, list_sort(list_distinct(list_transform({found("said", dims.CVE_PATTERN, 0, True)}, lambda x: upper(x)))) AS named,
  list_sort(list_distinct(list_transform({found("said", dims.TECHNIQUE_PATTERN, 0, True)}, lambda x: upper(x)))) AS techniques FROM g1),
judged AS (SELECT *, list_filter(list_concat(
  list_transform(short, lambda x: {_told("cve_authenticity", "error", _M["malformed_cve"], "upper(x)")}),
  list_transform(named, lambda x: CASE WHEN cast(split_part(x, '-', 2) AS int) < {dims.FIRST_CVE_YEAR} OR cast(split_part(x, '-', 2) AS int) > {YEAR + 1} THEN {_told("cve_authenticity", "error", _M["cve_year"], "x")}
    WHEN len(known) > 0 AND NOT list_contains(known, x) THEN {_told("cve_authenticity", "warning", _M["unknown_cve"], "x")} END),
  list_transform(commands, lambda c: CASE WHEN (length(c) - length(replace(c, chr(39), ''))) % 2 = 1 THEN {_told("command_syntax", "error", q(dims.MESSAGES["unreadable_command"].format(error="No closing quotation")), "c")}
    WHEN NOT ({_KNOWN}) THEN {_told("command_syntax", "warning", _M["unknown_executable"], "c")} END),
  [{_RISKS}],
  [CASE WHEN {_DESTRUCTIVE} AND rollback = '' THEN {_told("policy_constraint", "error", _M["no_rollback"], "''")} END, CASE WHEN {_DESTRUCTIVE} AND len(evidence) = 0 THEN {_told("policy_constraint", "warning", _M["no_evidence"], "''")} END],
  list_transform(list_filter(techniques, lambda t: NOT list_contains(paths, t)), lambda t: {_told("attack_path", "warning", _M["foreign_technique"], "t")}),
  [CASE WHEN len(stages) > 0 AND len(techniques) = 0 AND len(list_filter(stages, lambda s: contains(lower(said), replace(s, '_', ' ')))) = 0 THEN {_told("attack_path", "warning", _M["silent_path"], "''")} END]
  ), lambda f: f IS NOT NULL) AS findings FROM g2),
marked AS (SELECT *, len(list_filter(findings, lambda f: f.severity = 'error')) = 0 AS accepted,
  len(list_filter(findings, lambda f: f.category = 'cve_authenticity' OR (f.category = 'attack_path' AND f.evidence <> ''))) > 0 AS hallucinated,
  len(list_filter(findings, lambda f: f.category = 'policy_constraint' AND f.severity = 'error')) > 0 AS unsafe, len(commands) AS command_count,
  len(list_filter(commands, lambda c: len(list_filter(findings, lambda f: f.category = 'command_syntax' AND f.evidence = c)) > 0)) AS incorrect_command_count FROM judged),
every_record AS (SELECT model, count(*) AS record_count FROM ({plain(GENERATIONS)}) v GROUP BY model),
totals AS (SELECT model, count(*) AS action_count, sum(command_count) AS command_count, count_if(hallucinated) AS hallucinated_actions, sum(incorrect_command_count) AS incorrect_commands, count_if(unsafe) AS unsafe_actions FROM marked GROUP BY model),
rates AS (SELECT model, record_count, action_count, cast(command_count AS bigint) AS command_count, cast(hallucinated_actions AS bigint) AS hallucinated_actions, cast(incorrect_commands AS bigint) AS incorrect_commands, cast(unsafe_actions AS bigint) AS unsafe_actions,
  coalesce(hallucinated_actions / action_count, 0.0) AS hallucinated_action_rate, coalesce(incorrect_commands / command_count, 0.0) AS incorrect_command_rate, coalesce(unsafe_actions / action_count, 0.0) AS unsafe_action_rate FROM every_record JOIN totals USING (model))
"""

EXAMPLE_CONTEXTS = f"""
WITH texts AS (SELECT printf('example-%06d', source_index) AS incident_id, trim(instruction) AS summary, trim(instruction) AS text FROM ({plain(EXAMPLES)}) x), {INCIDENTS} {GRAPH}
"""
