"""Error rates of generated responses, and comparison of two models over the same prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import dims
from emberlog.functions.textfx import let
from emberlog.operators.gate import any_finding, validate

RATES = ("hallucinated_action_rate", "incorrect_command_rate", "unsafe_action_rate")


def evaluate_actions(records: DataFrame, as_of_year: int, index: str = "record_index", **options) -> DataFrame:
    """One row for each action: records' columns, action_index, action, findings and the metrics' marks.

    An action is hallucinated if a CVE or a technique in it has no ground, unsafe if a policy was
    violated. A command is incorrect if a syntax finding names it; repeated commands count each time.
    """
    judged = validate(records, as_of_year, **options)
    cve = any_finding(F.col("findings"), lambda f: f["category"] == "cve_authenticity")
    path = any_finding(F.col("findings"), lambda f: f["category"] == "attack_path", lambda f: f["evidence"] != "")
    unsafe = any_finding(F.col("findings"), lambda f: f["category"] == "policy_constraint", lambda f: f["severity"] == "error")
    named = F.transform(F.filter("findings", lambda f: (f["category"] == "command_syntax") & (f["evidence"] != "")), lambda f: f["evidence"])
    wrong = let(named, lambda bad: F.filter(F.col("action")["command"], lambda c: F.array_contains(bad, c)))
    return judged.withColumns({
        "hallucinated": cve | path,
        "unsafe": unsafe,
        "command_count": F.size(F.col("action")["command"]).cast("long"),
        "incorrect_command_count": F.size(wrong).cast("long"),
    })


def rate(numerator: Column, denominator: Column) -> Column:
    """Their quotient, 0.0 over nothing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def report(records: DataFrame, details: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates, overall or for each value of `by`. Records without actions count as records."""
    ones = records.select(*by, F.lit(1).cast("long").alias("r"), *[F.lit(0).cast("long").alias(c) for c in "acihu"])
    flags = details.select(*by, F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("a"), F.col("command_count").alias("c"), F.col("incorrect_command_count").alias("i"), F.col("hallucinated").cast("long").alias("h"), F.col("unsafe").cast("long").alias("u"))
    summed = ones.unionByName(flags).groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "racihu"])
    c = {x: F.col(x) for x in "racihu"}
    return summed.select(
        *by, c["r"].alias("record_count"), c["a"].alias("action_count"), c["c"].alias("command_count"),
        c["h"].alias("hallucinated_actions"), c["i"].alias("incorrect_commands"), c["u"].alias("unsafe_actions"),
        rate(c["h"], c["a"]).alias(RATES[0]), rate(c["i"], c["c"]).alias(RATES[1]), rate(c["u"], c["a"]).alias(RATES[2]),
    )


def record_id(df: DataFrame) -> Column:
    """The first of the id columns that is there and not null, as text."""
    there = [F.col(f"`{c}`").cast("string") for c in dims.ID_KEYS if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def pairing_violations(baseline: DataFrame, candidate: DataFrame, index: str = "record_index") -> DataFrame:
    """Positions that only one side has, or where both have ids that differ."""
    left = baseline.select(index, record_id(baseline).alias("baseline_id"), F.lit(True).alias("__b"))
    right = candidate.select(index, record_id(candidate).alias("candidate_id"), F.lit(True).alias("__c"))
    both = left.join(right, index, "full_outer")
    kind = F.when(F.col("__b").isNull() | F.col("__c").isNull(), "unpaired").when(F.col("baseline_id") != F.col("candidate_id"), "id_mismatch")
    return both.select(index, "baseline_id", "candidate_id", kind.alias("violation")).where("violation is not null")


def validate_paired(baseline: DataFrame, candidate: DataFrame, index: str = "record_index") -> None:
    """ValueError if the two sides are not the same prompts in the same order."""
    found = pairing_violations(baseline, candidate, index).orderBy(index).limit(1).collect()
    if not found:
        return
    row = found[0]
    if row["violation"] == "unpaired":
        raise ValueError(dims.INPUT_MESSAGES["unequal"])
    raise ValueError(dims.INPUT_MESSAGES["unpaired"].format(index=row[index], baseline=row["baseline_id"], candidate=row["candidate_id"]))


def compare_reports(reports: DataFrame, baseline: str, candidate: str, model: str = "model") -> DataFrame:
    """From one report row for each model: a row for each metric with change, improvement and relative reduction."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("rate")) for m in RATES])).alias("m")
    rows = reports.select(F.col(model).alias("__model"), "record_count", long).select("__model", "record_count", "m.*")
    side = lambda name: F.max(F.when(F.col("__model") == name, F.col("rate")))
    both = rows.groupBy("metric").agg(side(baseline).alias("b"), side(candidate).alias("c"), F.max(F.when(F.col("__model") == baseline, F.col("record_count"))).alias("n"))
    b, c = F.col("b"), F.col("c")
    return both.select(
        F.lit(baseline).alias("baseline_name"), F.lit(candidate).alias("candidate_name"), F.col("n").alias("paired_record_count"), "metric",
        b.alias("baseline_rate"), c.alias("candidate_rate"), (c - b).alias("absolute_change"), (b - c).alias("absolute_improvement"),
        F.try_divide(b - c, F.nullif(b, F.lit(0.0))).alias("relative_reduction"),
    )


def compare_models(baseline: DataFrame, candidate: DataFrame, as_of_year: int, names: tuple[str, str] = ("baseline", "candidate"), evaluate: Callable[..., DataFrame] = evaluate_actions, **options) -> DataFrame:
    """Check the pairing, evaluate both sides in one pass and compare.

    evaluate may be another evaluator: of (records, as_of_year, options) it makes one row for each action with `model`
    and the marks of evaluate_actions.
    """
    validate_paired(baseline, candidate)
    columns = [c for c in baseline.columns if c in candidate.columns]
    both = baseline.select(*columns, F.lit(names[0]).alias("model")).unionByName(candidate.select(*columns, F.lit(names[1]).alias("model")))
    return compare_reports(report(both, evaluate(both, as_of_year, **options), ("model",)), *names)
