"""The queries of this subpackage: one for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, license_scan, media_chunks, mixing, ngram_join, quality_rules, secret_scan, suffix_dedup, toxicity
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.digest(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.learn(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op8_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Query]:
    own = [op1_toxicity, op2_media_chunks, op3_license_scan, op4_secret_scan, op5_suffix_dedup, op6_language, op7_quality_rules, op8_cube_mix, op9_ngram_join, op10_byte_bpe]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": license_scan.oracle_sql(), "op7_quality_rules": quality_rules.oracle_sql(), "op9_ngram_join": ngram_join.oracle_sql()}
