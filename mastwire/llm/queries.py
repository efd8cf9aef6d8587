"""The thin queries of the thirteen operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mastwire.llm import (
    chat, divergence, html, jaccard, language, neighbours, packing, pii, prefixes, quality, repeats, rules, templates,
)
from mastwire.llm.store import table


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(table(spark, folder, "pages"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # The text that stays; a character that a cut divides shows as U+FFFD.
    return repeats.removed(table(spark, folder, "documents")).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


def op5_tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    return chat.linked(chat.from_conversations(table(spark, folder, "conversations")), chat.TOOLS)


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return templates.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("doc_key")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.clusters(table(spark, folder, "documents"))


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(table(spark, folder, "conversations"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_pii": op4_pii,
    "op5_tool_call_linking": op5_tool_call_linking,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {"op12_prefix_trie": prefixes.ORACLE, "op13_source_divergence": divergence.ORACLE}
