"""The registered corpus queries, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfvec.llm import (
    class_lm,
    contamination,
    conversation_repair,
    extraction,
    fertility,
    host_reputation,
    language_id,
    lines,
    pieces,
    prefix_trie,
    simhash,
    suffix_dedup,
    token_files,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"))


def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks_of(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(table(spark, sf_dir, "documents"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_verdicts(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.page_texts(table(spark, sf_dir, "pages"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(table(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_contamination": op2_contamination,
    "op3_language": op3_language,
    "op4_class_lm": op4_class_lm,
    "op5_simhash": op5_simhash,
    "op6_fertility": op6_fertility,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_extraction": op8_extraction,
    "op9_lines": op9_lines,
    "op10_pieces": op10_pieces,
    "op11_repair": op11_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_host_reputation": op13_host_reputation,
}

ORACLES: dict[str, str] = {
    "op9_lines": lines.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_host_reputation": host_reputation.SQL,
}
