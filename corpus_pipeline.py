"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planwise.llm import mixing, ngram_join, quality_ordinal, sentence_pieces, suffix_dedup
from planwise.llm.storage import collect, drop, materialize, shrink


#: Repeated strings of so many bytes are looked for, with trigger strings of ANCHOR bytes. In prose a passage of
#: PASSAGE_WORDS words is longer; what repeats is taken out where it has so many whole words.
PASSAGE_BYTES, ANCHOR, PASSAGE_WORDS = 200, 32, 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go.

    It rejects bad quality, not toxicity. Null and empty texts are decided by the model's thresholds alone; a null doc_id is
    no label's; repeated rows share a decision; columns of other names are carried. An empty table gives an empty one.
    """
    return quality_ordinal.select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the row of the least doc_id, then text hash, stays, once.

    Documents without words and those with a null doc_id link with nothing and stay; different texts under one doc_id
    are different documents; columns of other names are carried.
    """
    shrink(spark)
    return ngram_join.representatives(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that start at two places are taken out of the texts, wherever they are; no document goes.

    A null text stays null; a text that is nothing but such passages becomes empty; rows of equal doc_id and text repeat
    each other; columns of other names are carried.
    """
    shrink(spark)
    return suffix_dedup.removed_text(docs, PASSAGE_BYTES, ANCHOR, PASSAGE_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words go. A null source is a source, a null doc_id a document."""
    shrink(spark)
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, as a digest; null and empty texts have none."""
    shrink(spark)
    return sentence_pieces.digest(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("encode", encode)]

#: The classifier and the encoder are beyond SQL; tests hold all after the classifier against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        drop(before)
        collect(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
