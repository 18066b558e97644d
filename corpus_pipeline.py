"""Corpus pipeline: quality rules, near-dedup, pseudonyms, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``, extra ones of any name included. An empty table passes
all stages and packs to an empty one. Texts of any length are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import mixing, packing, pii, quality_rules, wordsets
from graphloom.llm.registry import PUBLIC_KEY
from graphloom.plans import Scratch
from graphloom.sources import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: null, empty and short texts among them. Repeated rows get equal
    verdicts."""
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at a similarity of 0.8 or more in shingles of five words, which no SimHash
    reaches; operator 6's index finds them by min-wise bytes. Null and empty texts are copies of each other; null ids
    come last."""
    return wordsets.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; null texts stay null. Equal values are linked across documents."""
    return pii.pseudonymize_documents(docs, spark.conf.get(pii.KEY_SETTING, PUBLIC_KEY))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts sources to their budgets; null sources are one, empty texts take no words and come as often as
    their source has whole epochs."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences; a row for each piece. Null and empty texts are a piece of the closing id."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Networks and token ids have no SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not packing_stage:
            docs = scratch.save(docs, name)
            if before:
                scratch.drop(before)
            before = name
    return docs
