"""The registered queries of the training-data operators: thin wrappers with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, media, merge_queue, ngram_join, packing, pii_crf, quality_gbt, rule_list, secrets_forest, shards, token_store, turn_repair, whitening
from tallyloom.llm.common import read_table


def _json_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_gbt.score_documents(docs, quality_gbt.fit(docs, read_table(spark, sf_dir, "labels")))


def op2_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii_crf.find(docs, pii_crf.fit(docs))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(read_table(spark, sf_dir, "documents"), token_store.new_folder(spark), _json_vocabulary()))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read_table(spark, sf_dir, "documents"), 8)


def op5_secrets_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_forest.scan(read_table(spark, sf_dir, "documents"), secrets_forest.fit(secrets_forest.labelled_findings()))


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return media.copies(media.render(vectors), vectors.withColumnRenamed("vec_id", "media_id"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), _json_vocabulary())


def op10_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rules = rule_list.fit(docs, read_table(spark, sf_dir, "labels"))
    return rule_list.judge(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(read_table(spark, sf_dir, "conversations"))


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_merge_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_queue.round_trip(read_table(spark, sf_dir, "documents"), _json_vocabulary())


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
