"""A corpus pipeline of five stages over ``documents``; each stage reads what the one before it wrote.

language ID -> line dedup -> SimHash near-dedup -> mixing sources to target weights -> SentencePiece round trip

Every stage takes null in any column, empty and very long texts, repeated rows, an empty table and columns of any name
beside those of documents, which stay to the last stage but one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import langid, linededup, mixing, sentencepieces, simhash
from twinfold.session import shared_path

PIECES = "piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts, those without a letter, or too uncertain, go.  Repeats are judged alike."""
    return langid.keep_identified(docs, public_tokenizers.path(PIECES))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many documents share and this one need not hold; n_chars is set anew.

    A text that loses no line stays as it is, null included; null ids are one document; each repeated row keeps its result.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    out = linededup.dedup_lines(plain, own["doc_id"], own["text"])
    value = {"text": F.col("_kept"), "n_chars": F.char_length("_kept").cast("long")}
    changed = {c: F.when(F.col("_n_dropped") > 0, value[c]).otherwise(F.col(own[c])) for c in value if c in own}
    return out.select(*[changed.get(c, F.col(own[c])).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, nulls last; null and empty texts are one group."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated, cut or left out so that sources, null among them, come near their targets; texts
    without a word vanish."""
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix; null texts count as empty."""
    return sentencepieces.round_trip_digests(docs, public_tokenizers.path(PIECES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express the language model and the tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages documents are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
