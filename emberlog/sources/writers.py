"""Writers: JSON lines, pretty JSON documents, the nested corpus document, aligned splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.textfx import json_string
from emberlog.runtime import materialize, remove_path, scratch_path

KEEP_NULLS = {"ignoreNullFields": "false"}


def json_lines(df: DataFrame, path: str) -> None:
    """One record a line, nulls included."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def pretty_documents(df: DataFrame, path: str) -> None:
    """Each row as a JSON document with line breaks; for reports of one or few rows."""
    df.select(F.to_json(F.struct(*df.columns), KEEP_NULLS | {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


#: Column, and its name in the corpus document.
SECTIONS = {"instruction": "instructions", "answer": "answers", "metadata": "metadata"}
DOCUMENT = "document.json"


def section_line(column: str, first: bool) -> str:
    return f'{"{" if first else "]], "}"{SECTIONS[column]}": [['


def corpus_document(examples: DataFrame, path: str) -> None:
    """The nested document {"instructions": [[...]], "answers": [[...]], "metadata": [[...]]} in the file document.json under path.

    This export is for tools that want a single document; Parquet rows are the format of record. Each value stands on
    a line of its own, in the order of source_index. The lines are made and sorted in parallel and joined as bytes, so that
    no process holds the document.
    """
    spark = examples.sparkSession
    columns = [c for c in SECTIONS if c in examples.columns]
    as_json = {c: json_string(F.col(c)) if isinstance(examples.schema[c].dataType, T.StringType) else F.coalesce(F.to_json(c, KEEP_NULLS), F.lit("null")) for c in columns}
    # The rows of equal source_index have one order in all sections.
    rows = materialize(examples.select("source_index", F.monotonically_increasing_id().alias("__row"), *[v.alias(c) for c, v in as_json.items()]), "corpus-rows")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lines = {c: scratch_path(spark, "corpus-lines") for c in columns}
    for c in columns:
        rows.orderBy("source_index", "__row").select(F.concat(F.lit(","), c).alias("value")).write.text(lines[c])
    fs.delete(at, True)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{DOCUMENT}"), True)
    try:
        for c in columns:
            out.writeBytes(section_line(c, c == columns[0]) + "\n")
            parts = [s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(lines[c])) if s.getPath().getName().startswith("part-") and s.getLen()]
            for k, part in enumerate(sorted(parts, key=lambda s: s.getPath().getName())):
                source = fs.open(part.getPath())
                if not k:
                    source.read()  # the comma in front of the first value
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
        out.writeBytes("]]}\n" if columns else "{}\n")
    finally:
        out.close()
    for made in lines.values():
        remove_path(spark, made)


def split_examples(examples: DataFrame, path: str) -> dict[str, int]:
    """Examples with a split column as Parquet, partitioned by it; the rows of each side."""
    examples.write.mode("overwrite").partitionBy("split").parquet(path)
    return {f"{r['split']}_examples": r["count"] for r in examples.sparkSession.read.parquet(path).groupBy("split").count().collect()}


def aligned_splits(original: DataFrame, enriched: DataFrame, path: str) -> dict[str, int]:
    """Both variants of the examples under one split column, partitioned by it: original/split=..., enriched/split=...

    The split of a row is decided once, in `original`; the enriched variant takes it by source_index.
    """
    original.write.mode("overwrite").partitionBy("split").parquet(f"{path}/original")
    chosen = original.select("source_index", "split")
    enriched.drop("split").join(chosen, "source_index").write.mode("overwrite").partitionBy("split").parquet(f"{path}/enriched")
    spark = original.sparkSession
    counts = {f"{kind}_{r['split']}": r["count"] for kind in ("original", "enriched") for r in spark.read.parquet(f"{path}/{kind}").groupBy("split").count().collect()}
    if any(counts.get(f"original_{s}") != counts.get(f"enriched_{s}") for s in ("train", "test")):
        raise ValueError("the original and enriched examples are not aligned")
    return counts
