"""From raw documents to token ids: language, near duplicates, secrets, source weights, encoding.

Every stage takes all documents its predecessor kept and calls one operator of ``pagewright.llm``. Each is a function of
(spark, docs, sf_dir); its result is written as Parquet below the shared folder and read back as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import byte_bpe, jaccard, language, mixing, secret_scan
from pagewright.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null texts and texts without a letter go. Texts in a language without labelled
    rows stay, as do all texts with a letter where nothing could be learned."""
    found = language.identify(docs.select(*COLUMNS), language.learn(docs))
    return found.where("told").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, what looks like a secret replaced in their texts; n_chars follows where a text changed."""
    found = secret_scan.scan(docs.select(*COLUMNS))
    changed = F.size("spans") > 0
    clean = secret_scan.redacted(found.withColumn("_changed", changed))
    length = F.when(F.col("_changed"), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decodes): packed ids of each copy, and whether they decode to its text."""
    found = byte_bpe.round_trip(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return found.select("doc_id", "source", "n_tokens", "ids", same.alias("decodes"))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", distinct),
    ("secret_scan", without_secrets),
    ("source_mix", mixed),
    ("byte_bpe", encoded),
]

#: SQL cannot express the first and the last stage; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
