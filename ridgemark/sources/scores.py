"""Score tables and id lists from text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.functions.names import base_name, strip_extension


def parse_scores(lines: DataFrame, origin: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``t_fpid, i_fpid, score`` of score lines, and the lines rejected.

    ``origin`` "mapreduce" reads ``score<TAB>template;input``; "rdd" reads
    ``(class;template,(input,score))``.
    """
    if origin == "mapreduce":
        pattern, groups = r"^([^\t]+)\t([^;]*);(.*)$", ("score", "t_fpid", "i_fpid")
    elif origin == "rdd":
        pattern, groups = r"^(?:.*;)?\(?([^,;]*),\(([^,]*),([^)]*)\)\)$", ("t_fpid", "i_fpid", "score")
    else:
        raise ValueError(f"origin must be 'mapreduce' or 'rdd', not {origin!r}")
    part = {name: F.regexp_extract("value", pattern, n + 1) for n, name in enumerate(groups)}
    rows = lines.select("value", strip_extension(part["t_fpid"]).alias("t_fpid"),
                        strip_extension(part["i_fpid"]).alias("i_fpid"),
                        part["score"].try_cast("double").alias("score"))
    return (rows.filter("score is not null").select("t_fpid", "i_fpid", "score"),
            rows.filter("score is null").select("value"))


def id_list(lines: DataFrame) -> DataFrame:
    """Distinct ids of a list of paths, without directory and extension."""
    return lines.select(base_name(F.col("value")).alias("fpid")).distinct()
