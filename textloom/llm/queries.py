"""Registered queries of this subpackage: one thin query for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, embedding_dups, fingerprints, line_dedup, mixing, near_dups, quality, token_files, toxicity, warc
from textloom.llm.common import table
from textloom.llm.mixing_sql import MIX_SQL
from textloom.sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(spread(table(spark, sf_dir, "embeddings")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.file_round_trip(documents(spark, sf_dir))


def op4_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(documents(spark, sf_dir))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.remove_repeats(docs, counts=True)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.groups(documents(spark, sf_dir)).drop("digest")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_embedding_dups": op1_embedding_dups,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_bottomk": op4_bottomk,
    "op5_mixing": op5_mixing,
    "op6_byte_cnn": op6_byte_cnn,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_order_minhash": op9_order_minhash,
    "op10_bpe": op10_bpe,
}

SQL: dict[str, str] = {
    "op1_embedding_dups": embedding_dups.COSINE_SQL,
    "op5_mixing": MIX_SQL,
    "op7_line_dedup": line_dedup.LINES_SQL,
    "op8_warc": warc.WARC_SQL,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
