"""The queries ``opN_<name>`` over the driver's tables, and their SQL.

Each reads its whole table, calls its operator with production parameters and
derives the contract's columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bin_completion import pack_documents
from .mixing import mix_sources
from .nn_descent import near_vectors
from .oracle import ORACLE_SQL
from .phrase_dedup import repeated_phrases
from .pii import KINDS, find_personal_data, span_text
from .pivot_clusters import centroid_clusters, digest
from .quality import quality_rules
from .simhash import simhash_groups
from .suffix_dedup import repeated_passages
from .token_bins import pack_token_rows
from .token_counts import token_counts
from .toxicity import toxicity_scores
from .whitening import by_component, whitened_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = span_text(F.col("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(base, 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"), min_words=50)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


def op6_token_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack_token_rows(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return rows.select("shard", "row", "n_tokens", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", "doc_ids", "pieces",
                       "starts")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases(table(spark, sf_dir, "documents"), window=13).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whitened_vectors(table(spark, sf_dir, "embeddings"), scale=256, components=4))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), dim=64, scale=64, k=16, rounds=3).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest("centroid").alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nn_descent": op1_nn_descent,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_bins": op6_token_bins,
    "op7_token_counts": op7_token_counts,
    "op8_phrase_dedup": op8_phrase_dedup,
    "op9_mixing": op9_mixing,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_pivot_clusters": op13_pivot_clusters,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
