"""One query for each operator over its whole table, with production parameters, and what SQL can say of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bigrams, decontamination, language, licenses, mixing, quality, sharding, simhash, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash", "group")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigrams.score(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages; doc_id or page_id names a row, the other is null."""
    found = licenses.scan(licenses.of_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")))
    number = F.substring("file", 2, 20).try_cast("long")
    return found.select(F.when(F.col("file").startswith("d"), number).alias("doc_id"), F.when(F.col("file").startswith("p"), number).alias("page_id"), "path", "own_license", "own_cosine", "license", "inherited_from", "depth")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_hilbert_shards, op4_simhash, op5_quality, op6_pitman_yor, op7_mixing, op8_tokens, op9_licenses, op10_language)}
ORACLES = {"op1_decontamination": decontamination.SQL, "op7_mixing": mixing.SQL}
