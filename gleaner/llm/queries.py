"""The ten operators as queries over the tables of a folder, each with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, conversations, decontaminate, html_main_text, language_codes, pii, quality, repeats, simhash, spotsigs, token_files, url_rules, vector_codes
from gleaner.llm.common import table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_benchmark_qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text.extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.summary(repeats.remove(table(spark, sf_dir, "documents")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edits(table(spark, sf_dir, "documents"))


def op11_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes.predict(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.summary(vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summary(conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_benchmark_qgrams": op2_benchmark_qgrams,
    "op3_html_main_text": op3_html_main_text,
    "op4_simhash": op4_simhash,
    "op5_byte_pairs": op5_byte_pairs,
    "op6_url_rules": op6_url_rules,
    "op7_token_files": op7_token_files,
    "op8_repeats": op8_repeats,
    "op9_pii": op9_pii,
    "op10_spotsigs": op10_spotsigs,
    "op11_language_codes": op11_language_codes,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op6_url_rules": url_rules.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
