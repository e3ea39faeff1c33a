"""Registered queries of the training-data operators: one per operator, each
over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressferry.llm import alignment, byte_bpe, decontaminate, fingerprints, jaccard_join, language_id, line_dedup, pitman_yor, prefix_trie, quality, sharding, token_files, top_k
from pressferry.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_prediction(table(spark, sf_dir, "documents"))


def op2_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder = token_files.rank_encoder(ranks, public_tokenizers.PATTERN)
    return token_files.token_counts(table(spark, sf_dir, "documents"), encoder, eod=50256, vocabulary=50257)


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = alignment.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return alignment.alignment_counts(table(spark, sf_dir, "documents"), files)


def op12_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_kneser_ney_language, op2_line_window_dedup, op3_separator_scan, op4_pitman_yor,
        op5_simhash_decontamination, op6_multiset_fingerprints, op7_ngram_jaccard,
        op8_feistel_sharding, op9_byte_bpe, op10_hierarchical_quality, op11_token_alignment, op12_threshold_top_k,
        op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_window_dedup": line_dedup.SUMMARY_SQL, "op12_threshold_top_k": top_k.TOP_K_SQL,
            "op13_prefix_trie": prefix_trie.PREFIX_TRIE_SQL}
