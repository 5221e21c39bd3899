"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feederflow.llm import bpe, forest, langid, mixing, perplexity, secrets, simhash, tokens, topk, urls
from feederflow.llm.common import documents


def tokenizer() -> str:
    """The vocabulary file of operators 1 and 2; FEEDERFLOW_TOKENIZER names another."""
    if path := os.environ.get("FEEDERFLOW_TOKENIZER"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(documents(spark, sf_dir), tokenizer())


def op2_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer())


def op3_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_word_first_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    return perplexity.filter_quality(documents(spark, sf_dir), trusted)


def op7_mixture_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op8_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(documents(spark, sf_dir))


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("kept")


QUERIES = {f.__name__: f for f in (op1_separator_scan, op2_bpe_lexicon, op3_url_language_model, op4_word_first_langid, op5_tiled_topk, op6_kneser_ney, op7_mixture_blocks, op8_blob_ledger, op9_projection_forest, op10_vantage_simhash)}

#: Queries of this package that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {}
