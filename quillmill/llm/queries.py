"""The operators of this folder over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import decontamination, embeddings, extraction, merkle, mixing, periods, pieces, prefixes, sharding, simhash, suffixes, tokens, toxicity
from quillmill.llm.tables import given


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(given(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.measure_repeats(given(spark, sf_dir, "documents"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(given(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(given(spark, sf_dir, "documents"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(given(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(given(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(given(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(given(spark, sf_dir, "documents"), digest=True)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(given(spark, sf_dir, "pages"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.measure_passages(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.rebuilt_trie(given(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.measure_runs(given(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    plan.__name__: plan
    for plan in (
        op1_toxicity,
        op2_embedding_near_dedup,
        op3_suffix_dedup,
        op4_balanced_shards,
        op5_simhash_near_dedup,
        op6_merkle_fingerprints,
        op7_token_counts,
        op8_source_mix,
        op9_sentencepiece,
        op10_html_text,
        op11_decontamination,
        op12_prefix_trie,
        op13_periodic_runs,
    )
}
SQL: dict[str, str] = {
    "op8_source_mix": mixing.SQL,
    "op11_decontamination": decontamination.SQL,
    "op12_prefix_trie": prefixes.SQL,
}
