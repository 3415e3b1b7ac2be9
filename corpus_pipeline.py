"""A corpus pipeline over `documents`: quality, near duplicates, benchmark leaks, secrets, token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; `run` writes each result as Parquet in the shared folder and rereads it as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe, decontam, quality, secrets, simhash
from emberlog.llm.common import clash_free, table
from emberlog.llm.registry import byte_codec
from emberlog.runtime import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    docs = clash_free(docs, *COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if model is None:  # nothing to learn from: nothing is rejected
        return docs
    return quality.scored(docs, model).where(F.col("score") >= quality.CUT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the one of the smallest doc_id."""
    docs = clash_free(docs, *COLUMNS)
    return simhash.keep_first(docs, simhash.near_copies(docs)).select(*COLUMNS)


def cut_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    return _measured(decontam.decontaminate(clash_free(docs, *COLUMNS), table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values judged secrets are replaced; no document goes."""
    return _measured(secrets.redact(clash_free(docs, *COLUMNS)))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (array) and n_tokens of each document."""
    return bpe.encode(docs.select("doc_id", "text"), byte_codec()).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode_tokens),
]

#: SQL can't express these stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
