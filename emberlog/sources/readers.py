"""Readers: log lines, incidents, action files, evaluation records, training corpora, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.records import RECORD, document_items, document_records, over_texts, record_fields
from emberlog.functions.textfx import LINE_ENDS
from emberlog.operators.graph import EDGE, NODE
from emberlog.operators.incident import IOC_TYPE
from emberlog.operators.training import limited, require_valid
from emberlog.runtime import ensure_importable
from emberlog.sources.writers import DOCUMENT, SECTIONS, section_line

INCIDENT = f"incident_id string, observed_at string, summary string, iocs {IOC_TYPE}, cves array<string>, assets array<string>, services array<string>, attack_stages array<string>, severity string, source string, raw_events array<string>"
CONTEXT = f"struct<incident:struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in INCIDENT.split(', ')))}>,nodes:array<{NODE}>,edges:array<{EDGE}>,recommendations:array<string>,prompt_context:string>"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def text_lines(spark: SparkSession, path: str, incident_id: str | None = None) -> DataFrame:
    """(incident_id, line_no, line) of text files; line_no only orders. Large files are read in splits.

    Lines end where str.splitlines ends them. Without incident_id each file is an incident.
    """
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    raw = spark.read.text(path, lineSep="\n").select(at.alias("at"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    cut = raw.select("at", F.posexplode(F.split("value", LINE_ENDS, -1)).alias("k", "line"))
    return cut.select(F.lit(incident_id).alias("incident_id") if incident_id else F.col("at.f").alias("incident_id"), F.struct("at.b", "at.i", "k").alias("line_no"), "line")


def inline_text(spark: SparkSession, text: str, incident_id: str) -> DataFrame:
    return spark.createDataFrame([(incident_id, 0, text)], "incident_id string, line_no int, line string")


def incident_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Incidents from JSON documents (or JSON lines): incident_id is required, everything else has a default."""
    found = spark.read.schema(INCIDENT).json(path, multiLine=not lines)
    defaults = {"observed_at": "", "summary": "", "severity": "unknown", "source": "log_parser"}

    def filled(f: T.StructField) -> F.Column:
        if f.name == "incident_id":
            return F.coalesce("incident_id", F.raise_error(F.lit("incident_id is missing")).cast("string")).alias(f.name)
        return F.coalesce(f.name, F.lit(defaults[f.name]) if f.name in defaults else F.array().cast(f.dataType)).alias(f.name)

    return found.select(*map(filled, found.schema.fields))


def action_file(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(pos, generation, kind) of a JSON, JSON-lines or text file with actions."""
    ensure_importable(spark)
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(over_texts(document_items, "struct<generation:string,kind:string>", F.col("value"))).alias("pos", "i"))
    out = items.select(F.col("pos").cast("long").alias("pos"), "i.generation", "i.kind")
    return out if limit is None else out.where(F.col("pos") < limit)


def _as_records(found: DataFrame) -> DataFrame:
    """Checked records; a record without a generation fails the job."""
    kept = F.when(F.col("r.problem").isNull(), F.col("r.generation")).otherwise(F.raise_error(F.col("r.problem")).cast("string"))
    return found.select("record_index", F.col("r.record_id").alias("record_id"), kept.alias("generation"), F.col("r.kind").alias("kind"), F.from_json("r.context", T._parse_datatype_string(CONTEXT)).alias("context"))


def evaluation_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_index, record_id, generation, kind, context) of one JSON document or JSON-lines file."""
    ensure_importable(spark)
    whole = spark.read.text(path, wholetext=True)
    return _as_records(whole.select(F.posexplode(over_texts(document_records, RECORD, F.col("value"))).alias("i", "r")).select(F.col("i").cast("long").alias("record_index"), "r"))


def evaluation_lines(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The same for JSON lines of any size, read in splits; `index` names the field that numbers the records."""
    import json

    ensure_importable(spark)
    lines = spark.read.text(path).where(F.trim("value") != "")
    at = F.get_json_object("value", f"$.{index}").cast("long")
    return _as_records(lines.select(at.alias("record_index"), over_texts(lambda t: [record_fields(json.loads(t))], RECORD, F.col("value"))[0].alias("r")))


def _document_of_lines(spark: SparkSession, path: str) -> str | None:
    """The file of a corpus document that has each value on a line of its own, as `corpus_document` writes it; else None."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name = path if fs.getFileStatus(fs_path(path)).isFile() else f"{path}/{DOCUMENT}"
    start = section_line("instruction", True) + "\n"
    if not fs.exists(fs_path(name)) or fs.getFileStatus(fs_path(name)).getLen() < len(start):
        return None
    opened = fs.open(fs_path(name))
    try:
        return name if "".join(chr(opened.readUnsignedByte()) for _ in start) == start else None
    finally:
        opened.close()


def _lines_of_document(spark: SparkSession, name: str) -> DataFrame | None:
    """The rows of such a document, read in splits; None if its lines turn out otherwise."""
    # A line's number is its place in its split plus the lines of the splits before. Ids run without gaps within a split.
    raw = spark.read.text(name, lineSep="\n").select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    marks = {section_line(c, not k): c for k, c in enumerate(SECTIONS)} | {"]]}": None}
    splits = raw.groupBy("split").agg(F.min("id").alias("first"), F.count("*").alias("n")).orderBy("split").collect()
    before, total = [], 0
    for r in splits:
        before.append((r["split"], total - r["first"]))
        total += r["n"]
    offset = F.create_map(*[F.lit(x) for pair in before for x in pair])
    numbered = raw.select((F.col("id") + F.element_at(offset, F.col("split"))).alias("line"), "value")
    found = sorted((r["line"], marks[r["value"]]) for r in numbered.where(F.col("value").isin(*marks)).collect())
    names = [c for _, c in found[:-1]]
    if names[:2] != ["instruction", "answer"] or names[2:] not in ([], ["metadata"]) or found[-1] != (total - 1, None):
        return None
    sizes = [b - a - 1 for (a, _), (b, _) in zip(found, found[1:], strict=False)]
    if len(set(sizes)) > 1:
        raise ValueError("instructions and answers differ in length")
    rows = None
    for (start, c), n in zip(found[:-1], sizes, strict=True):
        own = numbered.where((F.col("line") > start) & (F.col("line") <= start + n)).select((F.col("line") - start - 1).alias("source_index"), F.concat(F.lit('{"v":'), F.ltrim(F.col("value"), F.lit(",")), F.lit("}")).alias("v"))
        kind = "v string"
        if c == "metadata":
            kind = spark.read.json(own.select("v").rdd.map(lambda r: r[0])).schema
        part = own.select("source_index", F.from_json("v", kind)["v"].alias(c)) if n else own.select("source_index", F.lit(None).cast("string").alias(c))
        rows = part if rows is None else rows.join(part, "source_index")
    return rows


def training_json(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(source_index, instruction, answer[, metadata]) of the three corpus shapes: nested arrays, flat arrays, a list of objects.

    A nested document with each value on its own line is read in splits; any other is one row of one task.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    name = _document_of_lines(spark, path)
    if name and (rows := _lines_of_document(spark, name)) is not None:
        return limited(rows, limit)
    found = spark.read.json(path, multiLine=True)
    names = {"instructions": "instruction", "answers": "answer", "metadata": "metadata"}
    if {"instructions", "answers"} <= set(found.columns):
        there = [c for c in names if c in found.columns]
        flat = found.select(*[(F.col(c)[0] if isinstance(found.schema[c].dataType.elementType, T.ArrayType) else F.col(c)).alias(c) for c in there])
        sizes = F.when(F.size("instructions") == F.size("answers"), F.col("instructions")).otherwise(F.raise_error(F.lit("instructions and answers differ in length")).cast(flat.schema["instructions"].dataType))
        zipped = flat.withColumn("instructions", sizes).select(F.posexplode(F.arrays_zip(*there)).alias("i", "z"))
        rows = zipped.select(F.col("i").cast("long").alias("source_index"), *[F.col(f"z.{c}").alias(names[c]) for c in there])
    elif {"instruction", "answer"} <= set(found.columns):
        # A list in one document is read by one task, so these ids are positions.
        rows = found.select(F.monotonically_increasing_id().alias("source_index"), *[c for c in names.values() if c in found.columns])
    else:
        raise ValueError("the corpus needs instructions and answers, or objects with instruction and answer")
    return limited(rows, limit)


def answers(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(source_index, answer) of a corpus file."""
    return training_json(spark, path, limit).select("source_index", "answer")


def preprocessed(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Enriched rows from Parquet, or from the corpus document where path ends in .json; a row whose validation failed is an error.

    Rows without metadata or without a validation in it pass.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if path.rstrip("/").endswith(".json"):
        rows = training_json(spark, path, limit)
        kind = rows.schema["metadata"].dataType if "metadata" in rows.columns else None
        return require_valid(rows) if isinstance(kind, T.StructType) and "validation" in kind.names else rows
    return require_valid(limited(spark.read.parquet(path), limit))


def training_examples(spark: SparkSession, mode: str, path: str, limit: int | None = None) -> DataFrame:
    """original: a corpus file; kg_rag: a preprocessed table."""
    if mode == "original":
        return training_json(spark, path, limit)
    if mode == "kg_rag":
        return preprocessed(spark, path, limit)
    raise ValueError(f"unknown training mode: {mode}")


def pick_instruction(examples: DataFrame, seed: int | None = None) -> DataFrame:
    """One row: any without a seed; else the least by a seeded hash of its index, the same for the same seed."""
    drawn = F.rand() if seed is None else F.xxhash64(F.lit(seed), "source_index")
    return examples.orderBy(drawn, "source_index").limit(1)


def context_document(spark: SparkSession, path: str | None) -> DataFrame:
    """One row with the column `context`, null without a path."""
    if path is None:
        return spark.range(1).select(F.lit(None).cast(CONTEXT).alias("context"))
    return spark.read.text(path, wholetext=True).select(F.from_json("value", T._parse_datatype_string(CONTEXT)).alias("context"))
