"""Training rows: enrichment with context, validation, and an aligned train/test split."""

from __future__ import annotations

import random
from array import array
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions import dims
from emberlog.functions.textfx import filled, json_block, json_string, strip
from emberlog.operators.gate import process
from emberlog.operators.graph import INCIDENT_FIELDS, context_struct, contexts
from emberlog.operators.incident import incidents
from emberlog.runtime import ensure_importable, materialize

COUNTED = ("iocs", "cves", "assets", "services", "attack_stages")


def limited(examples: DataFrame, limit: int | None) -> DataFrame:
    """The first rows by source_index."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    return examples if limit is None else examples.where(F.col("source_index") < limit)


def validation() -> Column:
    """Of a row of `contexts`: ok, errors, and counts of what was extracted and built."""
    expected = F.array_compact(F.array(*[F.when(F.size(field) > 0, F.lit(relation)) for field, relation in dims.RELATIONS]))
    missing = F.array_sort(F.array_except(expected, F.transform("edges", lambda e: e["relation"])))
    said = dims.VALIDATION_MESSAGES
    listed = filled(said["relations"], names=F.array_join(F.transform(missing, lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", "))
    errors = F.array_compact(F.array(
        F.when(F.size(missing) > 0, listed),
        F.when(~F.exists("nodes", lambda n: n["type"] == "incident"), F.lit(said["no_incident"])),
        F.when(F.coalesce("prompt_context", F.lit("")) == "", F.lit(said["no_prompt"])),
    ))
    counts = F.struct(*[F.size(c).cast("long").alias(c) for c in COUNTED])
    built = F.struct(F.size("nodes").cast("long").alias("nodes"), F.size("edges").cast("long").alias("edges"))
    return F.struct((F.size(errors) == 0).alias("ok"), errors.alias("errors"), counts.alias("incident_counts"), built.alias("kg_counts"))


def incident_document() -> Column:
    """The incident's fields as a JSON document, one member a line, indented by two blanks a level."""
    listed = ("cves", "assets", "services", "attack_stages", "raw_events")

    def value(name: str) -> Column:
        if name == "iocs":
            pair = lambda x: json_block(F.array(*[F.concat(F.lit(f'"{k}": '), json_string(x[k])) for k in ("type", "value")]), 2, "{}")
            return json_block(F.transform("iocs", pair), 1)
        return json_block(F.transform(name, json_string), 1) if name in listed else json_string(F.col(name))

    return json_block(F.array(*[F.concat(F.lit(f'"{name}": '), value(name)) for name in INCIDENT_FIELDS]), 0, "{}")


def enrich(examples: DataFrame, depth: int = 2, observed_at: str = "", id_prefix: str = "example-") -> DataFrame:
    """examples(source_index, instruction, answer) with the enriched instruction and its metadata. Narrow."""
    entry = strip(F.coalesce("instruction", F.lit("")))
    events = F.when(entry != "", F.array(entry)).otherwise(F.array().cast("array<string>"))
    named = examples.select("source_index", "instruction", "answer", F.format_string(f"{id_prefix}%06d", F.col("source_index")).alias("incident_id"), events.alias("raw_events"))
    built = contexts(incidents(named, observed_at), depth).withColumn("validation", validation())
    text = F.concat(
        entry, F.lit(f"\n\n{dims.ENRICHMENT_PREAMBLE}\n<incident_json>\n"), incident_document(), F.lit("\n</incident_json>\n<kg_rag_context>\n"), F.col("prompt_context"), F.lit("\n</kg_rag_context>")
    )
    metadata = F.struct("source_index", F.struct(*INCIDENT_FIELDS).alias("incident"), context_struct().alias("kg_rag"), "validation")
    return built.select("source_index", F.col("instruction").alias("original_instruction"), text.alias("instruction"), "answer", metadata.alias("metadata"))


def require_valid(enriched: DataFrame) -> DataFrame:
    """enriched, or ValueError if a row's validation failed."""
    told = F.col("metadata.validation")
    bad = enriched.where(told.isNotNull() & ~F.coalesce(told["ok"], F.lit(False))).select("source_index", "metadata.validation.errors").limit(1).collect()
    if bad:
        raise ValueError(f"enrichment failed for example {bad[0][0]}: {bad[0][1]}")
    return enriched


def test_count(n: int, ratio: float) -> int:
    """Rows of the test side: rounded half to even, at least one, at most all but one."""
    if not 0.0 < ratio < 1.0:
        raise ValueError(dims.INPUT_MESSAGES["ratio"])
    if n < 2:
        raise ValueError(dims.INPUT_MESSAGES["too_few"])
    return max(1, min(n - 1, round(n * ratio)))


LITERAL_ROWS = 5_000_000
BLOCK_BITS = 16


def _joined(examples: DataFrame, bits: bytearray) -> DataFrame:
    """examples with split by a table of the bits, one row for each 2**BLOCK_BITS source_index values."""
    size = 1 << (BLOCK_BITS - 3)
    spark = examples.sparkSession
    rows = [(k, bytes(bits[k * size : (k + 1) * size])) for k in range(-(-len(bits) // size))]
    table = materialize(spark.createDataFrame(rows, "__block long, __bits binary"), "split-bits")
    at = F.col("source_index").cast("long")
    within = at.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(within, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    in_test = F.expr("shiftleft(1, cast(source_index & 7 as int))").bitwiseAND(byte) != 0
    joined = examples.withColumn("__block", F.shiftright(at, BLOCK_BITS)).join(F.broadcast(table) if len(bits) < 1 << 25 else table, "__block", "left")
    return joined.withColumn("split", F.when(in_test, "test").otherwise("train")).select(*examples.columns, "split")


def with_split(examples: DataFrame, ratio: float = dims.TEST_RATIO, seed: int = dims.SPLIT_SEED, exact: bool = True) -> DataFrame:
    """examples with split ('train' or 'test'); source_index must run from 0 without gaps.

    exact follows the seeded shuffle of positions that a single process would make, at every size; its
    permutation is built on the driver (4 bytes a row) and becomes one bit a row: a literal up to
    LITERAL_ROWS rows, beyond it a table of blocks that is joined. Otherwise rows are ranked by a seeded
    hash, in parallel: an exact count, but other members.
    """
    if not 0.0 < ratio < 1.0:
        raise ValueError(dims.INPUT_MESSAGES["ratio"])
    n = examples.count()
    wanted = test_count(n, ratio)
    if exact:
        order = array("i" if n < 1 << 31 else "q", range(n))
        random.Random(seed).shuffle(order)
        bits = bytearray(-(-n // 8))
        for i in order[:wanted]:
            bits[i >> 3] |= 1 << (i & 7)
        if n > LITERAL_ROWS:
            return _joined(examples, bits)
        at = F.col("source_index").cast("int")
        byte = F.conv(F.substring(F.hex(F.lit(bytes(bits))), (F.shiftright(at, 3) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        in_test = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(source_index as int) & 7)")) != 0
        return examples.withColumn("split", F.when(in_test, "test").otherwise("train"))
    # The hash that ranks `wanted`-th is found over buckets, not by one global sort.
    hashed = examples.withColumn("__h", F.xxhash64(F.lit(seed), "source_index"))
    buckets = hashed.groupBy(F.shiftrightunsigned("__h", 44).alias("b")).count().orderBy("b").collect()
    taken, border, rest = 0, None, 0
    for b, size in buckets:
        if taken + size >= wanted:
            border, rest = b, wanted - taken
            break
        taken += size
    edge = [r[0] for r in hashed.where(F.shiftrightunsigned("__h", 44) == border).orderBy("__h", "source_index").select("source_index").limit(rest).collect()]
    inside = (F.shiftrightunsigned("__h", 44) < border) | F.col("source_index").isin(edge)
    return hashed.withColumn("split", F.when(inside, "test").otherwise("train")).drop("__h")


def predictions(examples: DataFrame, generate: Callable[[str], str], model: str, as_of_year: int, post_process: bool = True, processor: Callable[..., DataFrame] = process) -> DataFrame:
    """Prediction records: generate is called once for each instruction inside the workers, then the gate runs.

    examples: source_index, instruction, answer and, optionally, metadata with kg_rag. A processed
    record carries the gate's report. What was generated is written before it is judged, so a record's
    text and its verdict come from one call even where the model samples; repeated ids keep their rows.
    processor may be another gate: of (rows, key, as_of_year, context) it makes one row for each key with the
    columns of `process`.
    """
    ensure_importable(examples.sparkSession)
    has_context = "metadata" in examples.columns
    context = F.col("metadata.kg_rag") if has_context else F.lit(None).cast("string")
    source = examples.select(F.col("source_index").cast("string").alias("id"), F.lit(model).alias("model_name_or_path"), "instruction", F.col("answer").alias("expected_answer"), context.alias("kg_context"))
    at = source.columns.index("instruction")
    schema = T.StructType([*source.schema.fields, T.StructField("generation", T.StringType())])

    def rows(batches):
        for batch in batches:
            made: list[Any] = [generate(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "generation"])

    made = source.mapInArrow(rows, schema).withColumn("post_processing_enabled", F.lit(post_process))
    if not post_process:
        return made.withColumn("post_processing", F.lit(None).cast("string"))
    made = materialize(made.withColumn("__row", F.monotonically_increasing_id()), "generations")
    verdicts = processor(made, "__row", as_of_year, context="kg_context" if has_context else None)
    report = F.struct("accepted", "actions", "blocked_actions", "findings", "summary").alias("post_processing")
    return made.join(verdicts.select("__row", report), "__row").drop("__row")


def preprocess(examples: DataFrame, path: str, ratio: float = dims.TEST_RATIO, seed: int = dims.SPLIT_SEED, limit: int | None = None, depth: int = 2, observed_at: str = "") -> dict[str, int]:
    """The whole preprocessing: first `limit` examples, enrichment, validation, split, both variants written under path.

    Returns the rows of each variant and side. A row that fails validation is a ValueError before anything is written.
    """
    from emberlog.sources.writers import aligned_splits

    chosen = limited(examples, limit)
    enriched = require_valid(materialize(enrich(chosen, depth, observed_at), "enriched"))
    return aligned_splits(with_split(chosen, ratio, seed), enriched, path)
