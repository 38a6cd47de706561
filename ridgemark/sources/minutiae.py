"""Minutiae sources: encoded lines, one-file-per-fingerprint, flat tables.

A *print row* is ``fpid, n, minutiae ARRAY<STRUCT<idx, x, y, th, q>>``; the
flat form has one minutia per row.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgemark.functions.angles import encode
from ridgemark.functions.names import base_name

INTEGER = r"^[+-]?[0-9]+$"
MAX_ANGLE = 360.0               # an angle beyond a full circle, infinite or not a number rejects its record


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines of one file, a folder or several paths, as column ``value``."""
    return spark.read.text(list(paths) if not isinstance(paths, str) else paths)


def _tokens(text, separator: str):
    return F.filter(F.split(text, separator), lambda t: t != "")


def _once(df: DataFrame, **fields) -> DataFrame:
    """``value, fpid`` and the named fields, as a generated row: what reads the fields does not compute them again."""
    kept = [c for c in ("value", "fpid") if c not in fields]
    return df.select(F.inline(F.array(F.struct(*kept, *[e.alias(n) for n, e in fields.items()]))))


def _parsed(df: DataFrame) -> DataFrame:
    """Add the parsed array to rows of ``value, fpid, records``.

    Records are read up to the first one without four tokens. A number that
    does not parse, or an empty prefix, rejects the whole fingerprint.
    """
    parts = F.transform("records", lambda r: _tokens(r, " "))
    first_bad = F.array_position(F.transform("parts", lambda p: F.size(p) != 4), True)
    keep = F.when(F.col("bad") == 0, F.col("parts")).otherwise(
        F.slice("parts", 1, F.greatest(F.col("bad") - 1, F.lit(0)).cast("int")))

    def angle(token):
        value = token.try_cast("double")
        return F.when(F.abs(value) <= MAX_ANGLE, value)

    def whole(p, i, kind):
        return F.when(p[i].rlike(INTEGER), p[i].try_cast(kind))

    minutiae = F.transform("parts", lambda p, i: F.struct(
        i.alias("idx"), whole(p, 0, "int").alias("x"), whole(p, 1, "int").alias("y"),
        encode(angle(p[2])).alias("th"), whole(p, 3, "tinyint").cast("int").alias("q")))
    split = _once(df, parts=parts).withColumn("bad", first_bad)
    return _once(_once(split, parts=keep), minutiae=minutiae)


def _sound():
    complete = F.forall("minutiae", lambda m: m["x"].isNotNull() & m["y"].isNotNull()
                        & m["th"].isNotNull() & m["q"].isNotNull())
    return F.coalesce(F.col("fpid").isNotNull() & (F.size("minutiae") > 0) & complete, F.lit(False))


def _split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    prints = df.filter(_sound()).select("fpid", F.size("minutiae").alias("n"), "minutiae")
    return prints, df.filter(~_sound()).select("value")


def parse_prints(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split lines ``fpid:x y t q;x y t q;…`` into print rows and rejects."""
    fields = lines.select(F.inline(F.array(F.struct("value", _tokens(F.col("value"), ":").alias("f")))))
    split = fields.select("value", F.get("f", F.lit(0)).alias("fpid"),
                          _tokens(F.get("f", F.lit(1)), ";").alias("records"))
    return _split_rejects(_parsed(split))


def parse_minutiae(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``parse_prints``, one minutia per row."""
    prints, rejects = parse_prints(lines)
    return flatten(prints), rejects


def flatten(prints: DataFrame) -> DataFrame:
    return prints.select("fpid", F.inline("minutiae"))


def read_xyt(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Print rows of one-fingerprint files with lines ``x y t q``.

    The fingerprint id is the file's base name.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = (spark.read.text(paths, wholetext=True)
             .select("value", base_name(F.col("_metadata.file_path")).alias("fpid")))
    records = F.split(F.regexp_replace(F.rtrim(F.col("value"), F.lit("\n\r")), "\r", ""), "\n")
    return _split_rejects(_parsed(files.withColumn("records", records)))[0]


def find_fingerprint(prints: DataFrame, fpid: str) -> DataFrame:
    return prints.filter(F.col("fpid") == fpid)


def merge_records(prints: DataFrame) -> DataFrame:
    """One print row per fingerprint: records of one id are one finger, numbered anew in the order of their content."""
    listed = F.flatten(F.array_sort(F.collect_list("minutiae")))
    numbered = F.transform("m", lambda m, i: F.struct(i.alias("idx"), m["x"].alias("x"), m["y"].alias("y"),
                                                      m["th"].alias("th"), m["q"].alias("q")))
    return (prints.groupBy("fpid").agg(listed.alias("m"))
            .select("fpid", F.size("m").alias("n"), numbered.alias("minutiae")))


def union_prints(*sets: DataFrame) -> DataFrame:
    first, *rest = sets
    for other in rest:
        first = first.unionByName(other)
    return first


def group_minutiae(flat: DataFrame, order_by: Sequence[str], parts: int | None = None) -> DataFrame:
    """Print rows from flat minutiae, numbered by ``order_by``.

    Only for fingerprints that fit one row; ``plans.enrol`` checks that first.
    ``parts`` is the number of partitions, by default as many as their bytes need.
    """
    flat = flat if parts is None else flat.repartition(parts, "fpid")
    listed = F.array_sort(F.collect_list(F.struct(*order_by, "x", "y", "th", F.col("q").alias("quality"))))
    numbered = F.transform("m", lambda m, i: F.struct(
        i.alias("idx"), m["x"].alias("x"), m["y"].alias("y"), m["th"].alias("th"),
        m["quality"].cast("int").alias("q")))
    return (flat.groupBy("fpid").agg(listed.alias("m"))
            .select("fpid", F.size("m").alias("n"), numbered.alias("minutiae")))
