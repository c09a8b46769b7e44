"""From raw documents to token ids: language, exact dedup, near dedup, mixing, byte-level BPE.

Each stage works on all that the one before kept, which is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import byte_bpe, exact_dedup, langid, mixing, near_dedup, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that get a language stay; those called und, as they have no letter or no text, go.

    Where no document has a label there are no languages, and documents with letters stay.
    """
    with scratch.owner(spark, "pipeline"):
        return langid.keep_known(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the smallest id stays."""
    with scratch.owner(spark, "pipeline"):
        return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of five-word shingles the one of the smallest id stays."""
    with scratch.owner(spark, "pipeline"):
        return near_dedup.keep_one(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target takes them, the last one up to the target."""
    with scratch.owner(spark, "pipeline"):
        return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of them and of the text that they decode to."""
    with scratch.owner(spark, "pipeline"):
        return byte_bpe.round_trip(docs, with_ids=True)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("byte_bpe", tokens)]

#: Languages and near duplicates are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with scratch.owner(spark, "pipeline-stages", clear=False):
            docs = scratch.write_table(out, name)
    return STAGES[-1][1](spark, docs, sf_dir)
