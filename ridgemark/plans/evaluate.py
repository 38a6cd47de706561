"""Evaluation of a score table against known genuine and impostor probes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgemark.functions.names import genuine
from ridgemark.operators.oversize import numbered
from ridgemark.operators.probes import cut

RANGES = 256


def rank1(scores: DataFrame) -> DataFrame:
    """Best template of each probe: highest score, then greatest template id."""
    best = scores.groupBy("i_fpid").agg(F.max(F.struct("score", "t_fpid")).alias("b"))
    return best.select("i_fpid", "b.t_fpid", "b.score")


def split_scores(scores: DataFrame, genuines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of genuine probes and of all other probes."""
    return scores.join(genuines, "i_fpid", "left_semi"), scores.join(genuines, "i_fpid", "left_anti")


def _per_probe(scores: DataFrame, genuines: DataFrame) -> DataFrame:
    """One pass over the scores: each probe's best pair, lowest score, and whether it is a genuine one.

    The rows, one per probe, are cut off, so what is asked of them does not read the scores again.
    """
    flags = genuines.select("i_fpid", F.lit(True).alias("own")).distinct()
    best = scores.groupBy("i_fpid").agg(F.max(F.struct("score", "t_fpid")).alias("best"), F.min("score").alias("low"))
    return cut(best.join(flags, "i_fpid", "left"))


def _range() -> Column:
    """Range of a score among RANGES of about equal counts, from a column ``cuts`` of sorted scores."""
    return F.size(F.filter("cuts", lambda c: c < F.col("score")))


def _cuts(scores: DataFrame) -> DataFrame:
    """One row ``cuts, total``: scores that divide the others into ranges, from a mergeable sketch."""
    shares = [k / RANGES for k in range(1, RANGES)]
    return scores.agg(F.array_distinct(F.percentile_approx("score", shares, 4 * RANGES)).alias("cuts"), F.count("score").alias("total"))


def _threshold(impostors: DataFrame, far: float) -> DataFrame:
    """The entry at position floor((1 - far) n) - 1 of ``score`` in ascending order, 0 when there is none.

    Positions come from counts per score in ranges of about equal counts,
    whatever the distribution; only the one range that holds the position is
    ordered. The ranges are approximate, the position is exact.
    """
    counts = (impostors.join(F.broadcast(_cuts(impostors))).groupBy(_range().alias("bucket"), "score", "total")
              .agg(F.count("*").alias("n")))
    upto = F.sum("n").over(Window.orderBy("bucket"))           # RANGES rows at most
    ranges = (counts.groupBy("bucket", "total").agg(F.sum("n").alias("n"))
              .select("bucket", upto.alias("end"), "n", F.floor((1 - F.lit(far)) * F.col("total")).alias("position"))
              .filter("position >= 1 and end >= position and end - n < position")
              .select("bucket", (F.col("position") - F.col("end") + F.col("n")).alias("place")))
    inside = counts.join(F.broadcast(ranges), "bucket").select(
        "score", "place", F.sum("n").over(Window.partitionBy("bucket").orderBy("score")).alias("upto"))
    return inside.filter("upto >= place").agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("threshold"))


def positions(scores: DataFrame) -> DataFrame:
    """Adds ``position``, the place of every score from 0 on, by (score, i_fpid, t_fpid).

    Rows are dealt out by ranges of that order, so equal scores do not meet in
    one task; each range is numbered apart and shifted by the counts of the
    ranges before it.
    """
    return numbered(scores, ["score", "i_fpid", "t_fpid"], "position")


def _impostors(probes: DataFrame, agg: str) -> DataFrame:
    score = {"max": F.col("best.score"), "min": F.col("low")}[agg]
    return probes.filter("own is null").select(score.alias("score"))


def threshold_at_far(scores: DataFrame, genuines: DataFrame, far: float = 0.0, agg: str = "max") -> DataFrame:
    """One row ``threshold``: the score that admits a share ``far`` of impostors.

    Each impostor probe counts with its highest (or, with agg="min", lowest) score.
    """
    return _threshold(_impostors(_per_probe(scores, genuines), agg), far)


def detailed(scores: DataFrame, db: str = "unknown") -> DataFrame:
    """Every score with the genuine flag of its pair."""
    return scores.select("i_fpid", "t_fpid", "score",
                         genuine(F.col("i_fpid"), F.col("t_fpid"), db).alias("genuine"))


def true_positives(scores: DataFrame, db: str) -> DataFrame:
    """One row ``tp``: probes whose best template is their own finger."""
    return detailed(rank1(scores), db).agg(F.count_if("genuine").alias("tp"))


def evaluate(scores: DataFrame, genuines: DataFrame, db: str = "sfinge", far: float | None = 0.0,
             agg: str = "max") -> DataFrame:
    """One row ``threshold, tp, fn, fnr`` of the genuine probes.

    ``far`` None evaluates without an impostor threshold.
    """
    probes = _per_probe(scores, genuines)
    size = genuines.agg(F.count("*").alias("size"))
    if far is None:
        limit = genuines.sparkSession.range(1).select(F.lit(0.0).alias("threshold"))
        own = probes.filter("own")
    else:
        limit = _threshold(_impostors(probes, agg), far)
        own = probes.filter("own").join(F.broadcast(limit)).filter(F.col("best.score") > F.col("threshold"))
    tp = own.agg(F.count_if(genuine(F.col("i_fpid"), F.col("best.t_fpid"), db)).alias("tp"))
    return limit.join(tp).join(size).select(
        "threshold", "tp", (F.col("size") - F.col("tp")).alias("fn"),
        ((F.col("size") - F.col("tp")) / F.col("size")).alias("fnr"))
