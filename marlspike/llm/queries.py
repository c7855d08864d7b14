"""The registered queries of this subpackage, over whole tables of a folder, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, chat, classifiers, exact_dedup, kdtree, mixing, ngram_join, packing, token_files
from .common import table, vocabulary


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifiers.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifiers.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op9_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op5_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(spark, path)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_token_attribution": op5_token_attribution,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_files": op7_token_files,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_kdtree_top_k": op9_kdtree_top_k,
    "op10_chat_formatting": op10_chat_formatting,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": mixing.SQL,
    "op4_ngram_jaccard_join": ngram_join.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op9_kdtree_top_k": kdtree.SQL,
    "op10_chat_formatting": chat.SQL,
}
