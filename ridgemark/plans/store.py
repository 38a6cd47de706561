"""Sinks: local-structure stores, score tables, evaluation tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE_FORMATS = ("parquet", "mapreduce", "rdd")
MAX_LISTED = 1000               # ids that a filter may hold


def write_templates(features: DataFrame, path: str) -> None:
    """Template store: one row per fingerprint, as it leaves enrolment (no shuffle)."""
    features.write.mode("overwrite").parquet(path)


def write_inputs(features: DataFrame, path: str) -> None:
    """Probe store, sorted by id within each file."""
    features.sortWithinPartitions("fpid").write.mode("overwrite").parquet(path)


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet", ordered: bool = False,
                 feature: str = "cylinder") -> None:
    """Score table as Parquet or in one of the two text forms."""
    if fmt not in SCORE_FORMATS:
        raise ValueError(f"format must be one of {SCORE_FORMATS}, not {fmt!r}")
    rows = scores.orderBy("score") if ordered else scores
    if fmt == "parquet":
        rows.write.mode("overwrite").parquet(path)
        return
    score = F.col("score").cast("string")
    line = (F.concat(score, F.lit("\t"), "t_fpid", F.lit(";"), "i_fpid") if fmt == "mapreduce" else
            F.concat(F.lit(f"({feature};"), "t_fpid", F.lit(",("), "i_fpid", F.lit(","), score, F.lit("))")))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def write_details(details: DataFrame, path: str) -> None:
    """Evaluation rows ``probe, template, score, genuine`` as tab-separated text."""
    (details.select("i_fpid", "t_fpid", "score", "genuine")
     .write.mode("overwrite").csv(path, sep="\t"))


def write_lookup(features: DataFrame, path: str, ids: int = 1_000_000, block_bytes: int = 16 << 20) -> None:
    """Store for point lookups: ranges of ids, sorted, with a Bloom filter of the ids of each row group.

    ``ids`` is the number of ids that a row group's filter is sized for.
    """
    (features.repartitionByRange("fpid", "chunk").sortWithinPartitions("fpid", "chunk").write.mode("overwrite")
     .option("parquet.bloom.filter.enabled#fpid", "true").option("parquet.bloom.filter.expected.ndv#fpid", str(ids))
     .option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.block.size", str(block_bytes)).parquet(path))


def lookup(store: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the store with the given ids (a list, or a table ``fpid``).

    Up to MAX_LISTED ids become a filter that reaches the scan, where ranges and
    Bloom filters skip row groups. More of them are joined.
    """
    if isinstance(ids, DataFrame):
        listed = [r[0] for r in ids.select("fpid").distinct().limit(MAX_LISTED + 1).collect()]
        if len(listed) > MAX_LISTED:
            return store.join(ids.select("fpid").distinct(), "fpid", "left_semi")
        ids = listed
    elif len(ids) > MAX_LISTED:
        return lookup(store, store.sparkSession.createDataFrame([(i,) for i in ids], "fpid string"))
    return store.filter(F.col("fpid").isin([i for i in ids if i is not None]))
