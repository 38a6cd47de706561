"""The registered queries of the text operators and their SQL."""

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ridgemark.llm import (alignment, bpe, chat, decontaminate, jaccard, langid, licenses, mixing, quality, rules, suffixes,
                           urls, whitening)
from ridgemark.llm.common import small_batches, table


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted preference pairs of ``conversations``."""
    return chat.digest(table(spark, sf_dir, "conversations"))


def op2_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text of ``documents`` without repeated bytes."""
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and robust outlier verdicts of every whole text of ``documents``."""
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of ``documents``."""
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``."""
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every URL of ``pages``."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.NAMED + urls.PATTERNS)


def op8_metric_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every whole text of ``documents``."""
    return jaccard.components_of(table(spark, sf_dir, "documents"))


def op9_license_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every whole text of ``documents``."""
    return licenses.digest(table(spark, sf_dir, "documents"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document of ``documents`` with the items of ``benchmark``."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector of ``embeddings``."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of two tokenizers on every whole text of ``documents``."""
    return alignment.alignment_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.path("piece_bpe_32k.model"))


def op13_hash_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document of ``documents``."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def _bounded(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {f.__name__: _bounded(f) for f in (
    op1_preference_format, op2_byte_convolution, op3_suffix_levels, op4_robust_outliers, op5_bpe_transducer, op6_hyperdimensional_language, op7_url_rules,
    op8_metric_jaccard, op9_license_positions, op10_spaced_seeds, op11_block_whitening, op12_galloping_alignment,
    op13_hash_thresholds)}
SQL: dict[str, str] = {"op1_preference_format": chat.oracle(),
                       "op7_url_rules": urls.oracle(urls.NAMED + urls.PATTERNS),
                       "op13_hash_thresholds": mixing.oracle()}
