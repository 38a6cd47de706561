"""Fingerprints derived from the star-schema tables.

Every part is an enrolled finger and each of its line items one minutia. The
probe list is the ``nation`` table: nation n asks for finger n. Nations of the
regions 0-2 send a second impression of that finger (shifted and jittered); the
others send a finger that is not enrolled.
Integer arithmetic only, so that any SQL engine derives the same rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgemark.functions.angles import encode

ORDER = ("ok", "ln", "sk", "pc", "q")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finger_name(key: str, impression: int):
    return F.expr(f"concat('Finger', lpad(cast({key} as string), 12, '0'), '_{impression}')")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey as pk", "l_orderkey as ok", "l_suppkey as sk", "l_linenumber as ln",
        "cast(round(l_extendedprice * 100) as bigint) as pc", "cast(l_quantity as int) as q")


# Directions follow a ridge field that turns slowly with the position.
_X, _Y = ("20 + ((ok*7919 + sk*104729 + ln*1299709 + pc*31) % 240)",
          "20 + ((ok*15485863 + sk*611953 + ln*7907 + pc*17) % 320)")
_A = "(((ok*7919 + sk*104729 + ln*1299709 + pc*31) % 240 + (ok*15485863 + sk*611953 + ln*7907 + pc*17) % 320) div 4 + (pc*13 + ok*101 + ln*37) % 24) % 180"
_FINGER = {"x": _X, "y": _Y, "a": _A}
_SECOND = {"x": f"{_X} + 12 + (ln % 3) - 1",
           "y": f"{_Y} - 9 + (sk % 3) - 1",
           "a": f"({_A} + ln % 2) % 180"}
_STRANGER = {"x": "20 + ((ok*611953 + sk*7919 + ln*15485863 + pc*29) % 240)",
             "y": "20 + ((ok*1299709 + sk*7907 + ln*104729 + pc*23) % 320)",
             "a": "(((ok*611953 + sk*7919 + ln*15485863 + pc*29) % 240 + (ok*1299709 + sk*7907 + ln*104729 + pc*23) % 320) div 4 + (pc*7 + ok*53 + ln*11) % 24) % 180"}


def _placed(df: DataFrame, fpid, exprs) -> DataFrame:
    return df.select(
        fpid.alias("fpid"), *ORDER,
        *[e.cast("int").alias(n) for n, e in exprs.items()]).withColumn("th", encode(F.col("a")))


def template_minutiae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat minutiae of the enrolled fingers, one row per line item."""
    exprs = {n: F.expr(e) for n, e in _FINGER.items()}
    return _placed(_lines(spark, sf_dir), finger_name("pk", 1), exprs)


def probe_minutiae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat minutiae of the probes."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    df = _lines(spark, sf_dir).join(nation, F.col("pk") == F.col("n_nationkey"))
    exprs = {n: F.when(F.col("n_regionkey") <= 2, F.expr(_SECOND[n])).otherwise(F.expr(_STRANGER[n]))
             for n in _SECOND}
    return _placed(df, finger_name("pk", 2), exprs)


def probe_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ids of the genuine and of the impostor probes."""
    nation = table(spark, sf_dir, "nation")
    name = finger_name("n_nationkey", 2).alias("i_fpid")
    return (nation.filter("n_regionkey <= 2").select(name),
            nation.filter("n_regionkey > 2").select(name))
