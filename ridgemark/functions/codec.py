"""Text forms of minutiae and local structures, printed and parsed as columns.

A minutia is ``idx x y th q``. A line of a structure is ``fpid;lsid;minutia;numbers``:
for vectors the numbers are distance, radial angle and turn of each neighbour, for
cylinders the norm and, after one more semicolon, the cells. A line with another
count of parts, or with a number that does not parse or does not fit, is a reject.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgemark.settings import CELLS, NEIGHBOURS

INTEGER = r"^[+-]?[0-9]+$"
_VECTOR = [f"{n}{k}" for k in range(1, NEIGHBOURS + 1) for n in "drv"]


def _joined(values: list[Column | str], separator: str) -> Column:
    return F.array_join(F.array(*[F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values]), separator)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def _whole(token: Column, kind: str) -> Column:
    return F.when(token.rlike(INTEGER), token.try_cast(kind))


def _minutia(tokens: Column) -> dict[str, Column]:
    """Fields of a minutia; directions and qualities are signed bytes."""
    kinds = {"idx": "int", "x": "int", "y": "int", "th": "tinyint", "q": "tinyint"}
    return {n: _whole(F.get(tokens, F.lit(k)), kind).cast("int") for k, (n, kind) in enumerate(kinds.items())}


def _split(lines: DataFrame, parts: int) -> DataFrame:
    return lines.select("value", F.split("value", ";").alias("p")).withColumn(
        "p", F.when(F.size("p") == parts, F.col("p")))


def _fields(split: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``value`` and the named fields, of columns that hold the split line.

    A generated row keeps a filter on the fields above it, so no line is split,
    and none is printed, once more for every field that is tested.
    """
    return split.select("value", F.inline(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))))


def _rejects(parsed: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    sound = F.lit(True)
    for c in columns:
        sound = sound & F.col(c).isNotNull()
    return parsed.filter(sound).select(columns), parsed.filter(~sound).select("value")


def print_minutiae(flat: DataFrame) -> DataFrame:
    """Lines ``fpid;idx x y th q`` of flat minutiae."""
    return flat.select(_joined(["fpid", _joined(["idx", "x", "y", "th", "q"], " ")], ";").alias("value"))


def parse_minutia_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat minutiae of such lines, and the lines that do not parse."""
    split = _split(lines, 2).withColumn("t", _tokens(F.get("p", F.lit(1))))
    fields = {n: F.when(F.size("t") == 5, c) for n, c in _minutia(F.col("t")).items()}
    parsed = _fields(split, {"fpid": F.nullif(F.get("p", F.lit(0)), F.lit("")), **fields})
    return _rejects(parsed, ["fpid", *fields])


def _head(quality: str = "0") -> list[Column | str]:
    return ["fpid", "lsid", _joined(["lsid", "x", "y", "th", F.lit(quality)], " ")]


def print_vectors(flat: DataFrame) -> DataFrame:
    """Lines of flat neighbourhood vectors."""
    return flat.select(_joined([*_head(), _joined(_VECTOR, " ")], ";").alias("value"))


def print_cylinders(flat: DataFrame) -> DataFrame:
    """Lines of flat cylinder codes."""
    cells = F.array_join(F.col("cm").cast("array<string>"), " ")
    return flat.select(_joined([*_head(), "norm", cells], ";").alias("value"))


def _structure(lines: DataFrame, parts: int) -> tuple[DataFrame, dict[str, Column]]:
    """Split lines with the tokens ``n`` of their last part, and the fields that all structures have."""
    split = _split(lines, parts).withColumns({"t": _tokens(F.get("p", F.lit(2))), "n": _tokens(F.get("p", F.lit(parts - 1)))})
    minutia = {n: F.when(F.size("t") == 5, c) for n, c in _minutia(F.col("t")).items()}
    own = {"fpid": F.nullif(F.get("p", F.lit(0)), F.lit("")), "lsid": _whole(F.get("p", F.lit(1)), "int")}
    return split, {**own, **{n: minutia[n] for n in ("x", "y", "th", "q")}}


def parse_vectors(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat neighbourhood vectors ``fpid, lsid, x, y, th, d*, r*, v*`` of lines, and the rejects."""
    rows, own = _structure(lines, 4)
    at = {n: F.when(F.size("n") == len(_VECTOR), F.get("n", F.lit(k))) for k, n in enumerate(_VECTOR)}
    fields = {n: at[n].try_cast("double") if n[0] == "d" else _whole(at[n], "tinyint").cast("int") for n in _VECTOR}
    parsed = _fields(rows, {**own, **fields})
    good, bad = _rejects(parsed, ["fpid", "lsid", "x", "y", "th", "q", *_VECTOR])
    return good.drop("q"), bad


def parse_cylinders(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat cylinder codes ``fpid, lsid, x, y, th, norm, cm`` of lines, and the rejects."""
    rows, own = _structure(lines, 5)
    rows = rows.withColumn("cells", F.transform("n", lambda t: t.try_cast("float")))
    sound = (F.size("cells") == CELLS) & F.forall("cells", lambda v: v.isNotNull())
    parsed = _fields(rows, {**own, "norm": F.get("p", F.lit(3)).try_cast("double"), "cm": F.when(sound, F.col("cells"))})
    good, bad = _rejects(parsed, ["fpid", "lsid", "x", "y", "th", "q", "norm", "cm"])
    return good.drop("q"), bad
