"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Language ID drops texts without a language, the n-gram Jaccard join keeps one document of each
group of near copies, decontamination drops texts that hold benchmark items, the secret scan masks
what it finds, and SentencePiece sampling encodes what is left. Null and empty texts go in the first
stage; rows without doc_id pass the others like any row. The last stage cannot be expressed in
SQL, nor can the first three; tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relearn.llm import decontaminate, language, ngram_join, secrets, sentence_pieces
from relearn.llm.catalog import PIECE_MODEL
from relearn.llm.common import crc_mod, pin


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = crc_mod(F.col("doc_id"), 5) != 0
    prototypes = language.learn_prototypes(docs, learned)
    return language.in_known_language(docs, prototypes, language.score_floors(docs, learned, prototypes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_samples(docs, PIECE_MODEL)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", masked_secrets),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs
