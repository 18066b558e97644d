"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import html_text, infill, katz, media, mixing, packing, pii, preference, quality_rules, repeats, resampling, secrets, simhash
from graphloom.sources import table


#: Key of the registered queries where the session has none. It is public, so it hides nothing; ``pii`` has no default.
PUBLIC_KEY = "graphloom-pseudonyms"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to the weights of their sources."""
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by preference pairs of the labelled ones that aren't held out."""
    return preference.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by format-preserving pseudonyms."""
    return pii.pii_digest(table(spark, sf_dir, "documents"), spark.conf.get(pii.KEY_SETTING, PUBLIC_KEY))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those at 3 bits or less."""
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes 50-byte strings that start in a document with a smaller id."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, with weak parts that complete a credential."""
    return secrets.secrets_digest(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as 8-bit samples, reads it back and sniffs it."""
    return media.media_digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers by language and source."""
    return quality_rules.quality_digest(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts every document in three and writes the parts in another order."""
    return infill.infill_digest(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws a tenth of the long enough documents towards the distribution of the benchmark's texts."""
    return resampling.resample_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a backoff model of those that aren't held out."""
    return katz.score_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_html_extraction": op5_html_extraction,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_media_columns": op9_media_columns,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE_MIX,
    "op7_suffix_dedup": repeats.ORACLE_REPEATS,
    "op11_fill_in_middle": infill.ORACLE_INFILL,
    "op12_importance_resampling": resampling.ORACLE_RESAMPLE,
}
