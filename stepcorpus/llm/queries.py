"""The ``opN_`` queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepcorpus.llm import (host_rules, html_blocks, language_mixture, licences, mixing, near_dups, pfor,
                            phrase_index, prefix_trie, pu_quality, suffix_dedup, top_k, turn_repair)
from stepcorpus.sources.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
CONTRACT_SHINGLE = 4


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_mix_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("host", "host_failed")


def op5_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return phrase_index.digest(found).drop("n_near")


def op6_pfor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.token_files(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), CONTRACT_SHINGLE)


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.identify(table(spark, sf_dir, "documents"))


def op9_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).withColumn("has_repeat", F.col("n_removed") > 0)


def op10_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("text"), "n_chars")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build_shared(table(spark, sf_dir, "conversations"))


def op12_repair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pu_quality, op2_licence_digests, op3_mix_budgets, op4_host_rules, op5_phrase_index, op6_pfor_files,
                                   op7_chosen_path, op8_language_mixture, op9_suffix_merge, op10_block_rules, op11_prefix_trie,
                                   op12_repair_weights, op13_tiled_top_k)}

#: DuckDB SQL, where it can express the operator on whole tables.
SQL = {"op2_licence_digests": licences.SQL, "op3_mix_budgets": mixing.SQL, "op4_host_rules": host_rules.SQL, "op5_phrase_index": phrase_index.SQL,
       "op11_prefix_trie": prefix_trie.SQL, "op12_repair_weights": turn_repair.SQL, "op13_tiled_top_k": top_k.SQL}
