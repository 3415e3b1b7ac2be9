"""Safety gate: findings of an action against rules and against its incident's context."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import dims
from emberlog.functions.records import shell_heads
from emberlog.functions.textfx import extract_all, filled, held, java, let
from emberlog.operators.actions import actions_of_rows
from emberlog.operators.incident import CVE
from emberlog.runtime import ensure_importable, once_each

FINDING = "struct<category:string,severity:string,message:string,evidence:string>"
SHORT_CVE = java(dims.MALFORMED_CVE_PATTERN, True)
TECHNIQUE = java(dims.TECHNIQUE_PATTERN, True)
_SAID = dims.MESSAGES


def _finding(category: str, severity: str, message: Column | str, evidence: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(category).alias("category"), lit(severity).alias("severity"), lit(message).alias("message"), lit(evidence).alias("evidence"))


def _none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _upper_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(values, F.upper)))


def present(context: Column) -> Column:
    """A context that is null, or has neither incident nor nodes, is none."""
    return context.isNotNull() & (context["incident"].isNotNull() | context["nodes"].isNotNull())


def _nodes(context: Column, kind: str) -> Column:
    return F.filter(F.coalesce(context["nodes"], F.array().cast("array<struct<id:string,type:string,name:string,properties:map<string,string>>>")), lambda n: n["type"] == kind)


def _strings(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def context_cves(context: Column) -> Column:
    named = F.transform(_nodes(context, "cve"), lambda n: F.coalesce(F.nullif(n["id"], F.lit("")), n["name"], F.lit("None")))
    return F.array_distinct(F.transform(F.concat(_strings(context["incident"]["cves"]), named), F.upper))


def context_techniques(context: Column) -> Column:
    own = F.transform(_nodes(context, "mitre_attack"), lambda n: F.coalesce(F.nullif(F.try_element_at(n["properties"], F.lit("technique_id")), F.lit("")), F.replace(F.coalesce(n["id"], F.lit("")), F.lit("attack:"), F.lit(""))))
    return F.array_distinct(F.transform(F.filter(own, lambda t: t != ""), F.upper))


def context_stages(context: Column) -> Column:
    named = F.transform(_nodes(context, "attack_stage"), lambda n: F.coalesce(F.nullif(n["name"], F.lit("")), n["id"], F.lit("")))
    return F.array_distinct(F.transform(F.concat(_strings(context["incident"]["attack_stages"]), named), F.lower))


def cve_findings(text: Column, trusted: Column, as_of_year: int, require_match: bool) -> Column:
    short = F.array_sort(F.array_distinct(extract_all(text, SHORT_CVE)))
    named = _upper_set(extract_all(text, CVE))
    malformed = F.transform(short, lambda t: _finding("cve_authenticity", "error", _SAID["malformed_cve"], F.upper(t)))

    def judged(cve: Column, trusted: Column) -> Column:
        year = F.split_part(cve, F.lit("-"), F.lit(2)).try_cast("int")
        far = _finding("cve_authenticity", "error", _SAID["cve_year"], cve)
        unknown = _finding("cve_authenticity", "warning", _SAID["unknown_cve"], cve)
        doubtful = (F.size(trusted) > 0) & ~F.array_contains(trusted, cve) if require_match else F.lit(False)
        return F.when((year < dims.FIRST_CVE_YEAR) | (year > as_of_year + 1), far).when(doubtful, unknown)

    return F.concat(malformed, let(trusted, lambda t: F.array_compact(F.transform(named, lambda cve: judged(cve, t)))))


def with_heads(df: DataFrame, commands: Column, into: str) -> DataFrame:
    """df with (error, head) of every command. Only arrays with quotes or backslashes reach Python."""
    ensure_importable(df.sparkSession)
    plain_head = lambda c: F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: w != "")

    def native(c: Column) -> Column:
        words = plain_head(c)
        head = F.when((F.get(words, 0) == "sudo") & (F.size(words) > 1), F.get(words, 1)).otherwise(F.get(words, 0))
        return F.struct(F.lit(None).cast("string").alias("error"), head.alias("head"))

    hard = F.exists(commands, lambda c: c.rlike(r"""['"\\]"""))
    asked = df.withColumn("__commands", F.when(hard, commands)).withColumn("__heads", shell_heads(F.col("__commands")))
    return asked.withColumn(into, F.coalesce("__heads", F.transform(commands, native))).drop("__commands", "__heads")


def command_findings(commands: Column, heads: Column) -> Column:
    def judged(command: Column, head: Column) -> Column:
        known = F.array_contains(F.array(*map(F.lit, dims.EXECUTABLES)), head["head"])
        verb = reduce(lambda a, b: a | b, [F.startswith(F.lower(head["head"]), F.lit(p)) for p in dims.EXECUTABLE_PREFIXES])
        unreadable = _finding("command_syntax", "error", filled(_SAID["unreadable_command"], error=head["error"]), command)
        return (
            F.when(head["error"].isNotNull(), unreadable)
            .when(head["head"].isNull(), _finding("command_syntax", "error", _SAID["empty_command"], command))
            .when(~(known | verb), _finding("command_syntax", "warning", _SAID["unknown_executable"], command))
        )

    return let(heads, lambda every: F.array_compact(F.transform(commands, lambda c, i: judged(c, F.get(every, i)))))


def policy_findings(action: Column) -> Column:
    joined = F.array_join(action["command"], "\n")
    blocked = [F.when(joined.rlike(java(p, True)), _finding("policy_constraint", "error", _SAID["high_risk"].format(reason=why), F.regexp_extract(joined, java(p, True), 0))) for p, why in dims.HIGH_RISK_PATTERNS]
    destructive = action["action_type"].isin(*dims.DESTRUCTIVE_TYPES)
    no_plan = _finding("policy_constraint", "error", _SAID["no_rollback"])
    no_proof = _finding("policy_constraint", "warning", _SAID["no_evidence"])
    rest = [F.when(destructive & (action["rollback"] == ""), no_plan), F.when(destructive & (F.size(action["evidence"]) == 0), no_proof)]
    return F.array_compact(F.array(*blocked, *rest))


def known(context: Column) -> Column:
    """What findings need of a context: small, so that it can go along with every action. Null for no context."""
    return F.when(present(context), held(F.struct(context_cves(context).alias("cves"), context_techniques(context).alias("techniques"), context_stages(context).alias("stages"))))


def path_findings(text: Column, known: Column) -> Column:
    named, stages = _upper_set(extract_all(text, TECHNIQUE)), known["stages"]
    foreign = F.transform(F.array_except(named, known["techniques"]), lambda t: _finding("attack_path", "warning", _SAID["foreign_technique"], t))
    told = let(F.lower(text), lambda low: F.exists(stages, lambda s: (s != "") & F.contains(low, F.replace(s, F.lit("_"), F.lit(" ")))))
    silent = _finding("attack_path", "warning", _SAID["silent_path"])
    missing = F.when((F.size(stages) > 0) & (F.size(named) == 0) & ~told, F.array(silent)).otherwise(_none())
    return F.when(known.isNotNull(), F.concat(foreign, missing)).otherwise(_none())


def with_findings(actions: DataFrame, known: str | None, as_of_year: int, allowed_cves: Iterable[str] = (), require_context_cve_match: bool = True) -> DataFrame:
    """actions (with `action` and, if named, a column of `known`) and their `findings`, in the order CVEs, commands, policy, attack path."""
    act = F.col("action")
    staged = actions.withColumn("__text", F.concat_ws("\n", act["source_action"], act["source_explanation"], F.array_join(act["command"], " ")))
    staged = with_heads(staged, act["command"], "__head")
    text = F.col("__text")
    allowed = F.array(*[F.lit(c.upper()) for c in allowed_cves]).cast("array<string>")
    parts = [command_findings(act["command"], F.col("__head")), policy_findings(act)]
    if known:
        at = F.col(f"`{known}`")
        trusted = F.when(at.isNotNull(), F.array_union(allowed, at["cves"])).otherwise(allowed)
        parts = [cve_findings(text, trusted, as_of_year, require_context_cve_match), *parts, path_findings(text, at)]
    else:
        parts = [cve_findings(text, allowed, as_of_year, require_context_cve_match), *parts]
    return staged.withColumn("findings", F.concat(*[p.cast(f"array<{FINDING}>") for p in parts])).drop("__text", "__head")


def is_error(finding: Column) -> Column:
    return finding["severity"] == "error"


def _grounded(df: DataFrame, generation: str, kind: str | None, context: str | None, ground: str | None) -> tuple[DataFrame, list[str], str | None]:
    """df with what its contexts tell; the columns on which alone a judgement depends; the name of that one."""
    told = df.withColumn("__known", known(F.col(f"`{context}`"))) if context and not ground else df
    ground = ground or ("__known" if context else None)
    return told, [c for c in (generation, kind, ground) if c], ground


def validate(df: DataFrame, as_of_year: int, generation: str = "generation", kind: str | None = None, context: str | None = None, ground: str | None = None, **options) -> DataFrame:
    """One row for each action: df's columns, action_index, action, findings, accepted.

    context names a column of contexts, ground one of what `known` made of them already. Equal generations with
    contexts that tell the same are judged once.
    """
    told, keys, ground = _grounded(df, generation, kind, context, ground)
    found = once_each(told, keys, lambda rows: with_findings(actions_of_rows(rows, generation, kind), ground, as_of_year, **options))
    return found.withColumn("accepted", ~F.exists("findings", is_error)).drop("__known")


def process(df: DataFrame, key: str, as_of_year: int, generation: str = "generation", kind: str | None = None, context: str | None = None, ground: str | None = None, **options) -> DataFrame:
    """One row for each generation: key, accepted, actions, blocked_actions, findings, summary.

    Actions are judged one by one and gathered by key, which must be unique (equal generations once, by their text and
    what their contexts tell); a generation without actions keeps its row and is accepted.
    """
    told, keys, ground = _grounded(df, generation, kind, context, ground)

    def gathered(rows: DataFrame) -> DataFrame:
        by = [key] if key in rows.columns else keys
        judged = with_findings(actions_of_rows(rows, generation, kind), ground, as_of_year, **options).withColumn("accepted", ~F.exists("findings", is_error))
        wrapped = judged.select(*by, F.struct("action_index", F.struct("action", "accepted", "findings").alias("x")).alias("w"))
        # Lists leave out the nulls, so that a generation without actions has an empty one.
        every = wrapped.unionByName(rows.select(*by, F.lit(None).cast(wrapped.schema["w"].dataType).alias("w")))
        return every.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list("w")), lambda a: a["x"]).alias("all"))

    whole = once_each(told.select(key, *keys), keys, gathered)
    blocked, kept = F.filter("all", lambda a: ~a["accepted"]), F.filter("all", lambda a: a["accepted"])
    found = F.flatten(F.transform("all", lambda a: a["findings"]))
    count = lambda level: F.size(F.filter(found, lambda f: f["severity"] == level)).cast("string")
    ok = F.size(blocked) == 0
    summary = filled(_SAID["summary"], status=F.when(ok, "accepted").otherwise("blocked"), total=F.size("all"), blocked=F.size(blocked), errors=count("error"), warnings=count("warning"))
    return whole.select(key, ok.alias("accepted"), kept.alias("actions"), blocked.alias("blocked_actions"), found.alias("findings"), summary.alias("summary"))


def any_finding(findings: Column, *tests) -> Column:
    return F.exists(findings, lambda f: reduce(lambda a, b: a & b, [t(f) for t in tests]))
