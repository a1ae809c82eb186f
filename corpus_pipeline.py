"""A corpus pipeline: documents of known languages, each text once and near copies once, mixed and packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``docs``, whatever these are called; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, langid, mixing, packing, simhash
from lectern.llm._common import materialize
from lectern.llm.queries import tokenizer_files


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no mixture of the learnt languages explains: null and empty texts, those without a letter,
    and those whose n-grams are less likely in it than if all were alike. A text in several languages stays, long ones
    are read whole, repeated rows are judged alike, and if no row is labelled all texts with a letter stay."""
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the one with the smallest id; null and empty texts are equal. Of a group without an id, and
    of repeated rows, one row stays; equal ids of unlike texts both do. Texts of any length are compared in full."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id; null texts and those without words
    are one group. Rows without an id, or with a repeated one, are told apart by their texts. Fingerprints are those of
    the registered query: four words, four bits, whole texts."""
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the sources' target weights, in global random order; a null source is a source of its own,
    null ids are drawn alike, repeated rows get the same count each, and texts aren't looked at."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens. Null and empty texts are their end alone, repeated rows
    are packed each on their own, and long texts fill sequences of their own."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mix_sources", mix_sources), ("packing", pack_sequences)]

#: Languages, fingerprints and tokens are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
