"""Response actions in a fixed schema, from free text, JSON text or structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import dims
from emberlog.functions.records import ITEM, parsed_items
from emberlog.functions.textfx import FLAT_OBJECT, WS, best_group, contains_any, extract_all, first_sentence_with, guarded, java, non_empty, rstrip, sentences, split_clean, strip
from emberlog.runtime import ensure_importable, exploded, once_each

#: A text that lacks the words has no match of the pattern.
_TARGET_WORDS = ((".",), ("@",), (), (":\\",), ("/",), (".exe", ".dll", ".sh", ".py", ".conf", ".log", ".service"))
TARGETS = tuple(zip(map(java, dims.TARGET_PATTERNS), _TARGET_WORDS, strict=True))
QUOTED = java(dims.QUOTED_COMMAND_PATTERN)
COMMANDS = java(dims.COMMAND_PATTERN, True)
ACTION = "struct<action_type:string,target:array<string>,command:array<string>,precondition:string,risk:string,rollback:string,evidence:array<string>,source_action:string,source_explanation:string>"
ACTION_FIELDS = ("action_type", "target", "command", "precondition", "risk", "rollback", "evidence", "source_action", "source_explanation")


def infer_action_type(lowered: Column) -> Column:
    return best_group(lowered, dims.ACTION_WORDS, "other")


def extract_targets(text: Column) -> Column:
    found = F.concat(*[guarded(contains_any(text, words), extract_all(text, p)) if words else extract_all(text, p) for p, words in TARGETS])
    return F.array_distinct(F.filter(F.transform(found, lambda x: rstrip(strip(x), ".,;)")), lambda x: x != ""))


def extract_commands(text: Column) -> Column:
    """Back-quoted spans, then known command words up to the end of their clause."""
    found = F.concat(guarded(F.contains(text, F.lit("`")), extract_all(text, QUOTED, 1)), extract_all(text, COMMANDS))
    clean = F.transform(found, lambda x: strip(F.substring_index(rstrip(strip(x), ".,;"), "`", 1)))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def _plain_item(text: Column) -> Column:
    """What a text without any brace is: an item of one field."""
    fields = {"source_action": strip(text), "whole": strip(text)}
    names = [part.split(":")[0] for part in ITEM[len("struct<") : -1].split(",")]
    return F.struct(*[fields.get(n, F.lit("")).alias(n) for n in names])


def _flat_item(keys: Column, values: Column, text: Column) -> Column:
    """The item of a JSON object of texts, from its lower-cased names and its values."""

    def field(names: tuple[str, ...]) -> Column:
        first = F.coalesce(*[F.nullif(F.array_position(keys, n), F.lit(0).cast("long")) for n in names], F.lit(0).cast("long"))
        return F.coalesce(strip(F.get(values, (first - 1).cast("int"))), F.lit(""))

    return F.struct(*[field(names).alias(n) for n, names in dims.ITEM_FIELDS.items()], strip(text).alias("whole")).cast(ITEM)


def with_items(df: DataFrame, generation: str = "generation", kind: str | None = None, into: str = "items") -> DataFrame:
    """df with the array of action items of each generation.

    kind names a column that tells how the generation came (string, object, array, other); without
    it all are text. Texts without braces and brackets, and JSON objects of texts, are settled here; the
    rest (nested values, JSON inside prose, broken JSON) go to the JSON function.
    """
    ensure_importable(df.sparkSession)
    text = F.coalesce(F.col(f"`{generation}`"), F.lit(""))
    how = F.col(f"`{kind}`") if kind else F.lit("string")
    plain = (how == "string") & ~(F.contains(text, F.lit("{")) | F.contains(text, F.lit("[")))
    flat = F.when((how == "string") & text.rlike(FLAT_OBJECT), F.from_json(text, "map<string,string>"))
    read = df.withColumns({"__kind": how, "__flat": flat})
    read = read.withColumns({"__keys": F.transform(F.map_keys("__flat"), F.lower), "__values": F.map_values("__flat")})
    keys = F.col("__keys")
    # Where two names differ in case only, the order of the document counts.
    once = F.size(F.array_distinct(keys)) == F.size(keys)
    here = read.withColumn("__here", F.when(plain, F.array(_plain_item(text).cast(ITEM))).when(keys.isNotNull() & once, F.array(_flat_item(keys, F.col("__values"), text))))
    made = here.withColumn("__parsed", parsed_items(F.when(F.col("__here").isNull(), text), F.col("__kind")))
    return made.withColumn(into, F.coalesce("__here", "__parsed")).drop("__kind", "__flat", "__keys", "__values", "__here", "__parsed")


def with_action(df: DataFrame, item: str = "item", into: str = "action") -> DataFrame:
    """df with the action (fixed schema) of an item: explicit fields win, the text supplies the others."""
    at = F.col(item)
    head = non_empty(at["source_action"], F.lit(None))
    text = non_empty(F.concat_ws("\n", head, non_empty(at["source_explanation"], F.lit(None))), at["whole"])
    staged = df.withColumn("__text", text)
    staged = staged.withColumns({"__low": F.lower("__text"), "__parts": sentences(F.col("__text"))})
    staged = staged.withColumns({"__lows": F.transform("__parts", F.lower), "__evidence": guarded(at["evidence"] != "", split_clean(at["evidence"], rf"[,;][{WS}]*"))})
    body = F.col("__text")
    told = lambda words: first_sentence_with(F.col("__low"), F.col("__parts"), F.col("__lows"), words)
    # A field that splits into nothing leaves an empty list; only a missing one is inferred.
    action = F.struct(
        non_empty(at["action_type"], infer_action_type(F.col("__low"))).alias("action_type"),
        F.when(at["target"] != "", split_clean(at["target"], rf"[,;][{WS}]*")).otherwise(extract_targets(body)).alias("target"),
        F.when(at["command"] != "", split_clean(at["command"], rf"[{WS}]*;[{WS}]*")).otherwise(extract_commands(body)).alias("command"),
        non_empty(at["precondition"], told(dims.PRECONDITION_WORDS)).alias("precondition"),
        non_empty(at["risk"], told(dims.RISK_WORDS)).alias("risk"),
        non_empty(at["rollback"], told(dims.ROLLBACK_WORDS)).alias("rollback"),
        F.when(F.size("__evidence") > 0, F.col("__evidence")).otherwise(F.filter(F.array(told(dims.EVIDENCE_WORDS)), lambda x: x != "")).alias("evidence"),
        at["source_action"].alias("source_action"),
        at["source_explanation"].alias("source_explanation"),
    )
    return staged.withColumn(into, action).drop("__text", "__low", "__parts", "__lows", "__evidence")


def actions_of_rows(df: DataFrame, generation: str = "generation", kind: str | None = None) -> DataFrame:
    """parse_actions, narrow: each row by itself."""
    items = exploded(with_items(df, generation, kind), "items", "item", *df.columns, place="action_index")
    return with_action(items).withColumn("action_index", F.col("action_index").cast("long")).drop("item")


def parse_actions(df: DataFrame, generation: str = "generation", kind: str | None = None) -> DataFrame:
    """One row for each action of each generation: df's columns, action_index, action. Equal generations are parsed once."""
    return once_each(df, [generation, *([kind] if kind else [])], lambda rows: actions_of_rows(rows, generation, kind))
