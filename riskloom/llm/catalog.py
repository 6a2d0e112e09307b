"""Registered queries of the training-data operators: whole tables, digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import chunk_bpe, conversation, language, line_dedup, minhash, packing, quality, secrets, spelling, suffix_dedup, topk_bits, warc, window_dedup
from riskloom.llm.oracle import ORACLE as ORACLE


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(spark, documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(spark, documents(spark, sf_dir))


def op5_topk_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_bits.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.digest(documents(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    return packing.digest(spark, documents(spark, sf_dir), tokenizer)


def op9_chunk_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    return chunk_bpe.digest(documents(spark, sf_dir), tokenizer)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(spark, documents(spark, sf_dir))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.digest(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(spark, documents(spark, sf_dir))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language": op2_language,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_topk_bits": op5_topk_bits,
    "op6_window_dedup": op6_window_dedup,
    "op7_minhash": op7_minhash,
    "op8_packing": op8_packing,
    "op9_chunk_bpe": op9_chunk_bpe,
    "op10_secrets": op10_secrets,
    "op11_conversations": op11_conversations,
    "op12_spelling": op12_spelling,
    "op13_warc": op13_warc,
}
