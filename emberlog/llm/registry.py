"""The queries of this subpackage, opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import audio, bpe, decontam, html_text, licenses, quality, secrets, simhash, token_store, url_rules
from emberlog.llm.common import table


@lru_cache(maxsize=1)
def byte_codec() -> bpe.Codec:
    return bpe.Codec.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), byte_codec())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound: each vector of `embeddings` is rendered as a recording."""
    found = audio.fingerprints_of_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return audio.matched(found).withColumnRenamed("id", "vec_id")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.report(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_byte_bpe, op3_secret_scan, op4_chroma, op5_url_rules, op6_decontamination, op7_simhash, op8_licenses, op9_quality, op10_html_text)}

#: DuckDB SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {"op5_url_rules": url_rules.ORACLE_SQL}
