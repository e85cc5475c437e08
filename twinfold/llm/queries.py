"""The registered queries of this subpackage, with oracle SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinfold.llm import itq, langid, licenses, linededup, maxscore, mixing, preferences, sentencepieces, simhash, tokenfiles


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, sf_dir))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(embeddings(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_file_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(embeddings(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(documents(spark, sf_dir))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_preferences(preferences.neighbouring_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_token_files": op4_token_files,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_top_k": op8_top_k,
    "op9_licenses": op9_licenses,
    "op10_preferences": op10_preferences,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op5_line_dedup": linededup.ORACLE,
    "op8_top_k": maxscore.ORACLE,
    "op10_preferences": preferences.ORACLE,
}
