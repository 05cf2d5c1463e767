"""A corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens. Each stage works on all that its predecessor kept.

All stages: an empty table gives an empty table. Nulls may stand in any column, and extra columns, whatever their names, are not
read and not carried along; the columns of documents are taken by name, and one that is missing is an error. Repeated rows are
rows of their own, but where a stage says otherwise. Texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import bpe, mixing, ngram_join, quality_rules, secret_scan
from terravane.llm.common import documents, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null, empty and blank texts have no words and go; repeated rows are judged alike."""
    return quality_rules.judge(docs.select(*COLUMNS), carry=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays, a null id being the greatest; among equal ids the text with
    the least SHA-256, and of rows that are equal in both any one. Texts without words, null ones included, have no duplicates and all stay."""
    return ngram_join.keep_first(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced in its text, overlapping ones together; all documents stay and n_chars follows. Null texts stay null, with
    n_chars null; empty texts stay."""
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them; those it doesn't take go. Null texts have size 0; a null source is a source of its own;
    rows that tie in size, hash and id are interchangeable."""
    taken = mixing.mix(docs.select(*COLUMNS), carry=("text", "lang", "source", "n_chars")).where("repeats > 0")
    return taken.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, by count and digests of ids and of the bytes they decode to; null and empty texts have none, repeated rows are
    encoded alike."""
    return bpe.digest(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("secret_scan", secrets), ("cube_mix", mix), ("byte_bpe", tokens)]

#: Trees, tests of randomness, balanced sampling and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
