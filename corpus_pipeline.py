"""A training corpus from raw documents: quality, near duplicates, repeated passages, source mix, tokens.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame; all but the last return the columns of
docs. run() applies them to `documents` and writes each result to the shared checkpoint folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import minhash_dedup, mixing, piece_codec, quality_cnn, substring_dedup
from kinmatch.llm.common import Scratch, documents, labels, training_sample

#: Probability of good quality below which a document goes.
QUALITY = 0.3
#: Words of a repeat that is removed.
PASSAGE = 50
#: How the names of the stages' own columns begin.
OWN = "_corpus_pipeline_"
#: Stages that SQL can't express (a trained network, a tokenizer): tested against brute force instead.
ORACLE_SQL = None


def _same(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network rejects; it learns from the labelled rows of `documents`, not of docs.

    A null text counts as empty. Repeated rows and rows with equal or null ids are judged one by one, by their texts.
    """
    net = quality_cnn.fit(training_sample(documents(spark, sf_dir), labels(spark, sf_dir), "quality", quality_cnn.SAMPLE))
    scored = quality_cnn.score_documents(docs, net, threshold=QUALITY, keep=True, prefix=OWN)
    return scored.where(F.col(f"{OWN}predicted") == 1).select(*_same(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the one of the smallest id, null last.

    Ids need not tell rows apart, and may be null: rows are numbered. Rows without words are in no group and stay.
    """
    row = f"{OWN}row"
    # The numbers stand for the ids; they are written, so that all who read them see the same ones.
    held = Scratch(spark, "near")
    rows = held.table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    named = rows.select(F.col(row).alias("_row"), F.col("doc_id"))
    placed = minhash_dedup.near_duplicates(rows.select(F.col(row).alias("_row"), "text"), id_col="_row").select("_row", "component_id").join(named.hint("merge"), "_row")
    best = placed.groupBy("component_id").agg(F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias(row))
    return rows.join(best.select(row).hint("merge"), row, "left_semi").select(*_same(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of PASSAGE words or more, and the white space behind each, out of all documents but the first that
    has them; all else stays as it is, line breaks and indentation too.

    Rows with equal ids do not take from each other; rows with null ids neither lose nor take; n_chars follows the text.
    """
    out = substring_dedup.dedup(docs, window=PASSAGE, form="spans", prefix=OWN)
    changed = F.col(f"{OWN}n_removed") > 0
    text = F.when(changed, F.col(f"{OWN}kept_text")).otherwise(F.col("text"))
    chars = F.when(changed, F.length(f"{OWN}kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*({"text": text.alias("text"), "n_chars": chars.alias("n_chars")}.get(c, F.col(f"`{c}`")) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix does: not at all, once, or up to three times. Documents without words go;
    repeated rows and rows with equal or null ids are documents of their own."""
    return mixing.kept_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves; a null text has none."""
    return piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True).drop("decoded")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = held.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
