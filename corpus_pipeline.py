"""A corpus pipeline of four operators: toxicity, language ID, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import language, near_dup, packing, toxicity
from kestrel.llm.common import read_table, stash
from kestrel.llm.registry import vocabulary

#: Documents that score at least this are rejected.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span tagger, learnt from the labelled ones among them, finds clean."""
    chain = toxicity.train(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, chain, TOXIC_FROM)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt; texts without a letter go."""
    return language.keep_identified(docs, language.train(docs, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, on 5-word shingles at 0.8."""
    return near_dup.keep_representatives(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed along the curve into sequences of 4096 ids."""
    return packing.pack_documents(docs, vocabulary(), end_id=2, length=4096, emit="ids")


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_dup", drop_near_copies), ("packing", pack)]

#: The stages learn, hash and follow a curve: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
