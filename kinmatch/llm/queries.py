"""The registered queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import ann_forest, embed_dedup, licenses, minhash_dedup, mixing, piece_codec, quality_cnn, sharding, substring_dedup, toxicity
from kinmatch.llm.common import documents, embeddings, held_out, labels, training_sample


def _scores(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = toxicity.fit(training_sample(docs, labels(spark, sf_dir), "toxic", toxicity.SAMPLE))
    return _scores(toxicity.score_documents(docs, grammar))


def op2_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(embeddings(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(documents(spark, sf_dir))


def quality_network(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_cnn.Network:
    return quality_cnn.fit(training_sample(docs, labels(spark, sf_dir), "quality", quality_cnn.SAMPLE))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scores(quality_cnn.score_documents(docs, quality_network(spark, docs, sf_dir)))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), n=2)


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(embeddings(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_ann_forest, op3_mixing, op4_substring_dedup, op5_quality_cnn, op6_piece_codec, op7_sharding, op8_licenses, op9_minhash_dedup, op10_embed_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE_SQL}
