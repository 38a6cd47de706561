"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from ridgemark.llm import stages
from ridgemark.llm.common import release, shared_folder, table, written

STAGES = [
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_passages", stages.repeated_passages),
    ("benchmark_free", stages.benchmark_free),
    ("encode", stages.encode),
]

# Language vectors, components, byte ranges and tokens are beyond SQL; tests hold a brute-force version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what earlier stages wrote is deleted once the next one's output stands."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        since = written()
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        release(spark, since, *([f"{folder}/{k - 1}-{STAGES[k - 1][0]}"] if k else []))
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
