"""Command line: python -m emberlog.cli incident|context|actions|gate|evaluate|compare|preprocess ...

Every command prints one JSON document. With --output, what grows with the input (actions, examples) is
written there by the executors; without it, actions are part of the printed document, for small inputs.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import dims
from emberlog.operators import actions, evaluation, gate, training
from emberlog.operators.graph import context_struct, contexts
from emberlog.operators.incident import parse_lines
from emberlog.sources import readers, writers

_NUMERATORS = dict(zip(evaluation.RATES, ("hallucinated_actions", "incorrect_commands", "unsafe_actions"), strict=True))
_DENOMINATORS = dict(zip(evaluation.RATES, ("action_count", "command_count", "action_count"), strict=True))


def _incidents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    now = datetime.now(UTC)
    name = args.incident_id or f"incident-{now:%Y%m%d%H%M%S}"
    lines = readers.text_lines(spark, args.input, name) if args.input else readers.inline_text(spark, args.text, name)
    return parse_lines(lines, now.isoformat())


def _one(df: DataFrame) -> dict[str, Any]:
    found = df.limit(1).collect()
    if not found:
        raise ValueError("the input holds nothing")
    return found[0].asDict(recursive=True)


def _incident(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    return _one(_incidents(spark, args))


def _context(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    found = readers.incident_json(spark, args.incident_json) if args.incident_json else _incidents(spark, args)
    return _one(contexts(found, args.depth).select(context_struct().alias("c")).select("c.*"))


def _actions(spark: SparkSession, args: argparse.Namespace) -> list[dict[str, Any]]:
    if args.from_dataset:
        given = readers.answers(spark, args.from_dataset, args.limit).select(F.col("source_index").alias("pos"), F.col("answer").alias("generation"), F.lit("string").alias("kind"))
    elif args.input:
        given = readers.action_file(spark, args.input, args.limit)
    else:
        given = spark.createDataFrame([(0, args.text, "string")], "pos long, generation string, kind string")
    parsed = actions.parse_actions(given, kind="kind")
    if args.output:
        writers.json_lines(parsed.select("pos", "action_index", "action.*"), args.output)
        return []
    return [r[0].asDict(recursive=True) for r in parsed.orderBy("pos", "action_index").select("action").collect()]


def _options(args: argparse.Namespace) -> dict[str, Any]:
    return {"as_of_year": args.as_of_year or datetime.now(UTC).year, "allowed_cves": args.allowed_cve, "require_context_cve_match": not args.allow_external_cves}


def _gate(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    text = args.generation if not args.input else (spark.read.text(args.input, wholetext=True).first() or [""])[0]
    given = readers.context_document(spark, args.kg_context).withColumns({"row": F.lit(0), "generation": F.lit(text)})
    return _one(gate.process(given, "row", context="context", **_options(args)).drop("row"))


def _metrics(report: dict[str, Any]) -> dict[str, Any]:
    counts = {c: report[c] for c in ("record_count", "action_count", "command_count")}
    return counts | {m: {"numerator": report[_NUMERATORS[m]], "denominator": report[_DENOMINATORS[m]], "rate": report[m]} for m in evaluation.RATES}


def _judged(spark: SparkSession, path: str, output: str | None, options: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(records, judged actions) of a file; the actions are written to output and read from there."""
    records = readers.evaluation_records(spark, path)
    details = evaluation.evaluate_actions(records, kind="kind", context="context", **options).drop("generation", "kind", "context")
    if not output:
        return records, details
    details.write.mode("overwrite").parquet(output)
    return records, spark.read.parquet(output)


def _listed(details: DataFrame, output: str | None) -> dict[str, Any]:
    """The judged actions for the document, unless they were written."""
    if output:
        return {}
    columns = ("record_index", "action_index", "action", "hallucinated", "unsafe", "command_count", "incorrect_command_count", "findings")
    return {"action_evaluations": [r.asDict(recursive=True) for r in details.select(*columns).orderBy("record_index", "action_index").collect()]}


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    records, details = _judged(spark, args.input, args.output and f"{args.output}/actions", _options(args))
    return _metrics(_one(evaluation.report(records, details))) | _listed(details, args.output)


def _compare(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    names = {"baseline": args.baseline_name, "candidate": args.candidate_name}
    sides = {side: _judged(spark, path, args.output and f"{args.output}/{side}_actions", _options(args)) for side, path in (("baseline", args.baseline_input), ("candidate", args.candidate_input))}
    evaluation.validate_paired(sides["baseline"][0], sides["candidate"][0])
    reports = {side: evaluation.report(*found).withColumn("model", F.lit(side)) for side, found in sides.items()}
    both = reports["baseline"].unionByName(reports["candidate"])
    found = {r["model"]: r.asDict() for r in both.collect()}
    changes = evaluation.compare_reports(spark.createDataFrame(list(found.values()), both.schema), "baseline", "candidate").collect()
    head = {f"{side}_name": name for side, name in names.items()} | {"paired_record_count": found["baseline"]["record_count"]}
    told = ("baseline_rate", "candidate_rate", "absolute_change", "absolute_improvement", "relative_reduction")
    return head | {side: _metrics(found[side]) | _listed(sides[side][1], args.output) for side in names} | {r["metric"]: {c: r[c] for c in told} for r in sorted(changes, key=lambda r: evaluation.RATES.index(r["metric"]))}


def _preprocess(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    examples = readers.training_json(spark, args.data_file)
    head = {"mode": args.mode, "source_data_file": args.data_file, "output_path": args.output, "test_ratio": args.test_ratio, "split_seed": args.split_seed}
    if args.mode == "kg_rag":
        return head | training.preprocess(examples, args.output, args.test_ratio, args.split_seed, args.limit, args.kg_depth, datetime.now(UTC).isoformat())
    return head | writers.split_examples(training.with_split(training.limited(examples, args.limit), args.test_ratio, args.split_seed), f"{args.output}/original")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="emberlog", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, run, about: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=about)
        made.set_defaults(run=run)
        return made

    def logs(made: argparse.ArgumentParser):
        one = made.add_mutually_exclusive_group(required=True)
        one.add_argument("--text", help="one log entry")
        one.add_argument("--input", help="text file of log lines")
        made.add_argument("--incident-id")
        return one

    def judging(made: argparse.ArgumentParser) -> None:
        made.add_argument("--allowed-cve", action="append", default=[], help="a trusted identifier; may be repeated")
        made.add_argument("--allow-external-cves", action="store_true", help="no finding for identifiers that the context lacks")
        made.add_argument("--as-of-year", type=int, help="the last year that an identifier may bear (default: this one)")

    logs(add("incident", _incident, "log lines to an incident"))
    made = add("context", _context, "an incident, or log lines, to its graph and prompt context")
    logs(made).add_argument("--incident-json", help="an incident document")
    made.add_argument("--depth", type=int, default=2)
    made = add("actions", _actions, "responses to actions of the fixed schema")
    one = made.add_mutually_exclusive_group(required=True)
    one.add_argument("--text")
    one.add_argument("--input", help="JSON, JSON lines or text")
    one.add_argument("--from-dataset", metavar="FILE", help="the answers of a corpus file")
    made.add_argument("--limit", type=int)
    made.add_argument("--output", help="folder for the actions as JSON lines, instead of printing them")
    made = add("gate", _gate, "one generation through the safety gate")
    one = made.add_mutually_exclusive_group(required=True)
    one.add_argument("--generation")
    one.add_argument("--input", help="file that holds the generation")
    made.add_argument("--kg-context", help="context document")
    judging(made)
    made = add("evaluate", _evaluate, "error rates of generated records")
    made.add_argument("--input", required=True)
    made.add_argument("--output", help="folder for the report and the judged actions")
    judging(made)
    made = add("compare", _compare, "two models over the same prompts")
    made.add_argument("--baseline-input", required=True)
    made.add_argument("--candidate-input", required=True)
    made.add_argument("--baseline-name", default="base")
    made.add_argument("--candidate-name", default="kg_rag_finetuned")
    made.add_argument("--output", help="folder for the report and both sides' judged actions")
    judging(made)
    made = add("preprocess", _preprocess, "a corpus file to enriched, checked and split examples")
    made.add_argument("--mode", choices=("original", "kg_rag"), default="kg_rag")
    made.add_argument("--data-file", required=True)
    made.add_argument("--output", required=True)
    made.add_argument("--limit", type=int)
    made.add_argument("--kg-depth", type=int, default=2)
    made.add_argument("--test-ratio", type=float, default=dims.TEST_RATIO)
    made.add_argument("--split-seed", type=int, default=dims.SPLIT_SEED)
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> Any:
    """Run one command; the document is printed and returned."""
    args = _parser().parse_args(argv)
    found = args.run(spark or SparkSession.builder.appName(f"emberlog {args.command}").getOrCreate(), args)
    text = json.dumps(found, indent=2, ensure_ascii=False)
    if args.command in ("evaluate", "compare") and args.output:
        session = spark or SparkSession.getActiveSession()
        session.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/report")
    print(text)
    return found


if __name__ == "__main__":
    main()
