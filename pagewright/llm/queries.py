"""Registered queries of this subpackage and the SQL each is checked against; None where SQL cannot express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import (byte_bpe, centroids, exact_topk, hash_forest, jaccard, language, licenses, line_dedup, mixing, phrases,
                            secret_scan, token_count, warc)
from pagewright.llm.checks import CLUSTERS, HISTORY, LICENSES, LINES, LINKS, MIX, PHRASES, SECRETS, TOPK
from pagewright.llm.common import table

#: Captures have no time of their own in ``pages``: the id counts seconds from here.
FIRST_CAPTURE = 1_700_000_000


def topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    return exact_topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and bytes of every document."""
    counted = token_count.token_counts(table(spark, folder, "documents").select("doc_id", "text"),
                                       public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    docs = byte_bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"),
                               public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, folder, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record, as its archive gives it back."""
    captured = F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) + FIRST_CAPTURE)
    entries = warc.capture_history(table(spark, folder, "pages"), captured)
    return entries.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector."""
    return hash_forest.nearest(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, 10)


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.digest(licenses.spans(table(spark, folder, "documents")))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's component."""
    found = jaccard.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.digest(secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text")))


def mix(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's cluster and how tight clusters are."""
    found = centroids.clusters(table(spark, folder, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document, how many go, and what stays."""
    return line_dedup.digest(line_dedup.deduplicated(table(spark, folder, "documents")))


def collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best collocations of each language."""
    return phrases.collocations(table(spark, folder, "documents"))


QUERIES = {
    "op1_exact_topk": (topk, TOPK),
    "op2_token_counts": (counts, None),
    "op3_byte_bpe": (round_trip, None),
    "op4_language_id": (languages, None),
    "op5_warc_history": (archives, HISTORY),
    "op6_hash_forest": (neighbours, None),
    "op7_license_scan": (license_scan, LICENSES),
    "op8_jaccard_join": (near_duplicates, LINKS),
    "op9_secret_scan": (secrets, SECRETS),
    "op10_source_mix": (mix, MIX),
    "op11_centroid_clusters": (clusters, CLUSTERS),
    "op12_line_dedup": (lines, LINES),
    "op13_phrase_mining": (collocations, PHRASES),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
