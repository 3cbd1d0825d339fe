"""Registered queries of the corpus operators: each applies one operator, with
production parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (
    decontaminate,
    hard_negatives,
    jaccard_join,
    language_id,
    packing,
    pii,
    prefix_trie,
    quality_classifier,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
)
from sightline.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeated_strings(docs, kept=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.predict(docs).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeated_words(docs, kept=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.digest_columns(decontaminate.contaminated_words(docs, items))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.similar_components(docs).select("doc_id", "n_shingles", "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest_columns(pii.find_pii(docs))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vec_id = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", label.alias("label")), vec_id % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.number_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    conv_id = F.col("conv_id")
    rebuilt = prefix_trie.graft(turns, conv_id - conv_id % 100, F.crc32(conv_id.cast("string").cast("binary")) % 6)
    return prefix_trie.prefix_trie(rebuilt)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in sorted(globals().items()) if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": quality_rules.oracle_sql(),
        "op6_url_filter": url_filter.oracle_sql(),
        "op7_substring_dedup": substring_dedup.oracle_sql(),
        "op8_decontaminate": decontaminate.oracle_sql(),
        "op9_jaccard_join": jaccard_join.oracle_sql(),
        "op11_hard_negatives": hard_negatives.oracle_sql(),
        "op12_prefix_trie": prefix_trie.oracle_sql(),
    }
