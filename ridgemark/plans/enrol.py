"""Enrolment: minutiae to local-structure rows."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.operators import cylinder, jiang, oversize
from ridgemark.operators.arrow import bounded_batches
from ridgemark.plans.registry import FEATURES
from ridgemark.settings import MAX_ROW_MINUTIAE
from ridgemark.sources.minutiae import flatten, group_minutiae, merge_records

# Ids listed up to this count are broadcast when oversized prints are set apart.
_BROADCAST_IDS = 100_000
# Scores of vectors whose match builds them.
LATE = ("jiang_local",)
# Minutiae of a task that builds and matches structures: some seconds of work.
_TASK_MINUTIAE = 1 << 16


def by_size(flat: DataFrame, order_by: Sequence[str], ordinary: Callable, large: Callable,
            limit: int = MAX_ROW_MINUTIAE, alone: Callable | None = None) -> DataFrame:
    """``ordinary(print rows)`` joined with ``large(flat minutiae)`` of oversized prints.

    ``alone`` stands for ``ordinary`` where no print is oversized; its work is
    long for its bytes, so partitions follow the number of minutiae.

    One aggregate over the id column comes first and decides whether oversized
    fingerprints need their own path. Without any, nothing is added to the
    plan: minutiae meet in one exchange, whose partitions Spark sizes by bytes.
    """
    sizes = flat.groupBy("fpid").agg(F.count("*").alias("n"))
    found, total = sizes.agg(F.count_if(F.col("n") > limit), F.sum("n")).first()
    if not found:
        return alone(group_minutiae(flat, order_by, _parts(flat, total or 1))) if alone else ordinary(group_minutiae(flat, order_by))
    big = sizes.filter(F.col("n") > limit).select("fpid")
    big = F.broadcast(big) if found <= _BROADCAST_IDS else big
    small = flat.join(big, "fpid", "left_anti")
    numbered = oversize.number_minutiae(flat.join(big, "fpid", "left_semi"), order_by)
    return ordinary(group_minutiae(small, order_by)).unionByName(large(numbered))


def _parts(flat: DataFrame, total: int) -> int:
    """Partitions of bounded work; of less, if that leaves fewer than three for a core."""
    few = min(-(-8 * total // _TASK_MINUTIAE), 3 * flat.sparkSession.sparkContext.defaultParallelism)
    return max(-(-total // _TASK_MINUTIAE), few)


def enrol(flat: DataFrame, order_by: Sequence[str], kind: str, role: str = "template",
          limit: int = MAX_ROW_MINUTIAE) -> DataFrame:
    """Local structures of flat minutiae (``fpid, x, y, th, q`` and order columns).

    ``role`` is "template" (only valid structures are kept) or "input"
    (invalid cylinders stay, as they count toward the size of a probe).
    """
    bounded_batches(flat.sparkSession)
    ordinary, large = _builders(kind, role)
    return by_size(flat, order_by, ordinary, large, limit)


def enrol_for_match(flat: DataFrame, order_by: Sequence[str], kind: str, limit: int = MAX_ROW_MINUTIAE,
                    score: str | None = None) -> DataFrame:
    """Templates that are matched once, for ``score`` or any other use of ``kind``, and not stored.

    Cylinders, and the vectors of the scores in LATE, stay unbuilt: the match takes
    print rows and builds them in its own task, so that they (cells are a hundred
    times the minutiae) never pass between Python and Spark, and a task needs
    one Python worker. With oversized fingerprints, and for all else, as ``enrol``.
    """
    bounded_batches(flat.sparkSession)
    ordinary, large = _builders(kind, "template")
    alone = (lambda prints: prints.filter("n > 0")) if kind == "cylinder" or score in LATE else None
    return by_size(flat, order_by, ordinary, large, limit, alone)


def build_local_structures(prints: DataFrame, kind: str, role: str = "template",
                           limit: int = MAX_ROW_MINUTIAE) -> DataFrame:
    """Local structures of print rows (``fpid, n, minutiae``); records of one id are merged.

    Minutiae are counted per id first. Records of an id beyond the bound are
    numbered by their content and merged as flat rows, never in one array.
    """
    bounded_batches(prints.sparkSession)
    ordinary, large = _builders(kind, role)
    sizes = prints.groupBy("fpid").agg(F.sum("n").alias("total"))
    found = sizes.agg(F.count_if(F.col("total") > limit)).first()[0]
    if not found:
        return ordinary(merge_records(prints))
    big = sizes.filter(F.col("total") > limit).select("fpid")
    big = F.broadcast(big) if found <= _BROADCAST_IDS else big
    records = oversize.numbered(prints.join(big, "fpid", "left_semi"), ["minutiae"], "record", ["fpid"])
    flat = records.select("fpid", "record", F.inline("minutiae")).withColumnRenamed("idx", "place")
    return (ordinary(merge_records(prints.join(big, "fpid", "left_anti")))
            .unionByName(large(oversize.number_minutiae(flat, ["record", "place"]))))


def number(flat: DataFrame, order_by: Sequence[str], limit: int = MAX_ROW_MINUTIAE) -> DataFrame:
    """Flat minutiae with their index in the fingerprint."""
    return by_size(flat, order_by, flatten, lambda f: f, limit)


def neighbours(flat: DataFrame, order_by: Sequence[str], limit: int = MAX_ROW_MINUTIAE) -> DataFrame:
    return by_size(flat, order_by, jiang.neighbour_rows, oversize.neighbour_rows, limit)


def hull_edges(flat: DataFrame, order_by: Sequence[str], limit: int = MAX_ROW_MINUTIAE) -> DataFrame:
    return by_size(flat, order_by, cylinder.hull_edges, oversize.hull_edges, limit)


def cylinder_digests(flat: DataFrame, order_by: Sequence[str], limit: int = MAX_ROW_MINUTIAE) -> DataFrame:
    """Counts and sums of the cells of all cylinders, invalid ones included."""
    bounded_batches(flat.sparkSession)
    return by_size(flat, order_by, cylinder.print_digests,
                   lambda f: cylinder.digests(oversize.cylinder_features(f, keep_invalid=True)), limit)


def _builders(kind: str, role: str) -> tuple[Callable, Callable]:
    if role not in ("template", "input"):
        raise ValueError(f"role must be 'template' or 'input', not {role!r}")
    if kind not in FEATURES:
        raise ValueError(f"unknown feature {kind!r}; one of {sorted(FEATURES)}")
    ordinary, large = FEATURES[kind].build, FEATURES[kind].large
    if large is None:
        def large(flat):
            raise ValueError(f"feature {kind!r} has no way for fingerprints of more than {MAX_ROW_MINUTIAE} minutiae")
    if kind != "cylinder":
        return ordinary, large
    keep = role == "input"
    return lambda p: ordinary(p, keep_invalid=keep), lambda f: large(f, keep_invalid=keep)
