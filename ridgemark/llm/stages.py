"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the next documents."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgemark.llm import bpe, decontaminate, jaccard, langid, suffixes
from ridgemark.llm.common import bit_table, bits_at, filter_bits, free_names, learnable, mix, small_batches, stored, table

FILTER_BITS = 26                 # at least; more for more decisions
WORDS, LINK = 5, (80, 100)       # near copies: shingles of five words, similarity of 0.8 or more


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Documents with a language: null texts and texts without letters go, the others get a lang where it is null.

    With ``languages`` only documents predicted as one of them stay. Without any
    prototype (no learnable row has a language) nothing can be predicted: all
    documents with letters stay, and null langs stay null.
    """
    small_batches(spark)
    prototypes = langid.learn(docs.filter(learnable(F.col("doc_id"))))
    guess, score = free_names(docs, "_lang_pred_", "_score_")
    judged = langid.predict(docs, prototypes, docs.columns, (guess, score), (None, ""))
    known = judged.filter(F.col(guess).isNotNull())
    kept = known if languages is None else known.filter(F.col(guess).isin(*languages) | (F.col(guess) == ""))
    lang = F.coalesce("lang", F.nullif(guess, F.lit("")))
    return kept.select(*[lang.alias(c) if c == "lang" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = WORDS,
                    link: tuple[int, int] = LINK) -> DataFrame:
    """One document of each component of near copies: the smallest doc_id, and one row of repeated ones.

    Two documents are near copies if their shingles of ``words`` words are at least
    ``link`` (numerator, denominator) similar.

    Rows are known by two 64-bit hashes of id and text. A filter sized by the number
    of decisions lets documents that nothing was decided about pass without a
    shuffle; only the others meet the table of decisions.
    """
    small_batches(spark)
    first, second, known_first, known_second, gone = free_names(docs, "_key_", "_key2_", "_known_", "_known2_", "_gone_")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string")
    keyed = docs.withColumns({first: F.xxhash64(*own), second: F.xxhash64(F.lit(1), *own)})
    known = keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                                  F.col(first).alias("key"), F.col(second).alias("key2")).alias("doc_id"), "text")
    found = jaccard.components_of(known, words, link).filter("n_shingles > 0")
    decided = stored(found.groupBy(F.col("doc_id.key").alias(known_first), F.col("doc_id.key2").alias(known_second),
                                   (F.col("doc_id") != F.col("component_id")).alias(gone))
                     .count().filter(F.col(gone) | (F.col("count") > 1)).drop("count"))
    bits = filter_bits(decided.count(), FILTER_BITS)
    shared = spark.sparkContext.broadcast(
        bit_table(decided.select(known_first), lambda batch: _place(batch.column(0).to_numpy(), bits), bits))
    names = keyed.columns

    def among(wanted: bool):
        def run(batches):
            for batch in batches:
                at = bits_at(shared.value, _place(batch.column(names.index(first)).to_numpy(), bits))
                yield batch.filter(pa.array(at == wanted))
        return keyed.mapInArrow(run, keyed.schema)

    met = among(True).join(decided, (F.col(first) == F.col(known_first)) & (F.col(second) == F.col(known_second)), "left")
    rest = among(False).unionByName(met.filter(F.col(gone).isNull()).select(*names))
    once = met.filter(~F.col(gone)).dropDuplicates([first, second]).select(*names)
    return rest.unionByName(once).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that other places of the corpus repeat."""
    small_batches(spark)
    return suffixes.cut_texts(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents left, with their counts and digests."""
    small_batches(spark)
    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)
