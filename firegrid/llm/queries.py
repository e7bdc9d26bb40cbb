"""Registered queries of the document operators, with production parameters over the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from firegrid.llm import byte_bpe, exact_dedup, fim, language, packing, quality, sharding, simhash, suffix_dedup, tokens, toxicity, warc
from firegrid.llm import whitening
from firegrid.llm.shared import documents, store

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tokens.round_trip(spark, documents(spark, sf_dir), WORD_TOKENIZER, end_id=2, dtype="<u2")
    return tokens.token_digests(records)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality.verdicts(quality.ledger(documents(spark, sf_dir)), "web-1")
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2b_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored once; what each rule of a policy adds is then a count over its bits."""
    return quality.ablations(store(quality.ledger(documents(spark, sf_dir)), "ledger"), "web-1")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), shards=8)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.learn(language.training_rows(docs)))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, BYTE_RANKS, public_tokenizers.PATTERN))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_TOKENIZER, end_id=0, capacity=2048, with_ids=False)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(documents(spark, sf_dir)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), radius=3)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(documents(spark, sf_dir), seed=42, rate=50, spm_rate=80))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4, scale=256)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_quality_rules": op2_quality_rules,
    "op2b_rule_ablations": op2b_rule_ablations,
    "op3_shards": op3_shards,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash": op10_simhash,
    "op11_toxicity": op11_toxicity,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op2_quality_rules": quality.ORACLE,
    "op2b_rule_ablations": quality.ABLATION_ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
}
