"""Consolidations: local matches to one score per (template, probe).

Similarities are whole millionths, so every sum, rank and merge is exact in
any order and Spark's partial aggregation applies. A pair without a positive
match has no row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgemark.functions.numeric import array_sum, np_expr, rounded
from ridgemark.operators.align import PAIR, alignment_scores
from ridgemark.operators.cylinder import TOTALS_SCHEMA, cylinder_summaries, every, half, top_totals
from ridgemark.operators.jiang import jiang_matches, local_totals, prepared
from ridgemark.operators.probes import ProbeSide, probe_shape
from ridgemark.operators.relax import (RHO_BLOCK, SCORES_SCHEMA, SUMS_SCHEMA, all_retained, half_retained, relaxed,
                                       rho_sums, summed)
from ridgemark.settings import IMPROVED_TOP, MAX_BROADCAST_LS, NP_MIN

MILLION = 1e6
_COUNTS = ("matched", "matches", "sl_sum", "over_n", "over_sum")


# --- neighbourhood vectors ---------------------------------------------------

def score_jiang_local(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """Sum of one-sided best similarities over the template size.

    Each template structure keeps its best match, then each probe structure
    its best of those: inside the match map where a template is one row, and by
    aggregates for templates in chunks and for large probe sets. Templates may be
    print rows, whose structures the map builds.
    """
    chunked = None if "minutiae" in templates.columns else templates.filter("n_chunks > 1")
    bound = MAX_BROADCAST_LS["jiang"]
    shape = probe_shape(inputs)
    if shape[1] > bound:
        return _local_score(_joined_totals(templates, inputs))
    some = chunked is not None and bool(chunked.limit(1).count())
    out = local_totals(templates.filter("n_chunks = 1") if some else templates, ProbeSide(inputs, bound, prepared, shape))
    return _local_score(_joined_totals(chunked, inputs).unionByName(out) if some else out)


def _joined_totals(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    best = jiang_matches(templates, inputs, best=True)
    assigned = best.groupBy("t_fpid", "n_t", "i_fpid", "i_lsid").agg(F.max("sl").alias("sl"))
    return assigned.groupBy("t_fpid", "n_t", "i_fpid").agg(F.sum("sl").alias("total"))


def _local_score(total: DataFrame) -> DataFrame:
    return total.select(*PAIR, rounded(F.col("total") / (F.col("n_t") * F.lit(MILLION))).alias("score"))


def score_jiang(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """Best alignment over the five best local matches of each pair."""
    return alignment_scores(templates, inputs)


# --- cylinder codes ----------------------------------------------------------

def summaries(templates: DataFrame, inputs: DataFrame, top=0, distinct: bool = False, sums: bool | str = False,
              finish=None, schema: str | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """One summary per pair; counts and sums of similarities only with ``sums`` ("over": of those above one half).

    Almost every fingerprint is one row, so its summary is final without a
    shuffle. Only fingerprints stored in several chunks, and sets with a probe
    beyond the bound, are merged, by an aggregate that sees at most ``top``
    matches per chunk and pair. ``finish``, a map of summaries to rows of ``schema``,
    runs in the task that matches, for the merged ones after their merge.
    """
    columns = ("t_fpid", "i_fpid", "n_t", "n_i", *_COUNTS, "top")
    shape = shape or probe_shape(inputs)

    def found(rows, **last):
        return cylinder_summaries(rows, inputs, top, distinct, shape=shape, sums=sums, **last)

    def whole(rows):
        return found(rows, finish=finish, schema=schema) if finish else found(rows).select(*columns)

    def merged(rows, split):
        out = merge_summaries(found(rows), top, distinct, split).select(*columns)
        return out.mapInArrow(finish, schema) if finish else out

    if shape[1] > MAX_BROADCAST_LS["cylinder"]:
        return merged(templates, True)
    chunked = None if "minutiae" in templates.columns else templates.filter("n_chunks > 1")
    if chunked is None or not chunked.limit(1).count():
        return whole(templates)
    return whole(templates.filter("n_chunks = 1")).unionByName(merged(chunked, False))


def merge_summaries(parts: DataFrame, top, distinct: bool, split: bool = False) -> DataFrame:
    """One summary per pair from those of template chunks and, if ``split``, of parts of a probe."""
    counts = parts.groupBy(*PAIR).agg(
        F.max("n_t").alias("n_t"), F.max("n_i").alias("n_i"), *[F.sum(c).alias(c) for c in _COUNTS])
    if split:
        hit = parts.select(*PAIR, F.explode("hits").alias("hit")).groupBy(*PAIR).agg(F.count_distinct("hit").alias("matched"))
        counts = counts.drop("matched").join(hit, list(PAIR))
    each = parts.select(*PAIR, "n_i", F.explode("top").alias("m")).select(*PAIR, "n_i", "m.*")
    rank = Window.partitionBy(*PAIR)
    if distinct:
        repeat = Window.partitionBy(*PAIR, "sl").orderBy(F.desc("t_lsid"), F.desc("i_lsid"))
        each = each.withColumn("copy", F.row_number().over(repeat)).filter("copy = 1").drop("copy")
    order = rank.orderBy(F.desc("sl"), F.desc("t_lsid"), F.desc("i_lsid"))
    limit = top(F.col("n_i")) if callable(top) else F.lit(top)
    best = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    names = [c for c in each.columns if c not in (*PAIR, "n_i")]
    lists = best.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct(*names)), asc=False).alias("top"))
    return counts.join(lists, list(PAIR), "left").withColumn(
        "top", F.coalesce("top", F.array().cast(dict(parts.dtypes)["top"])))


def _top_mean(df: DataFrame, n: Column) -> DataFrame:
    total = array_sum(F.slice(F.transform("top", lambda m: m["sl"]), F.lit(1), n))
    return df.select(*PAIR, rounded(total / (n * F.lit(MILLION))).alias("score"))


def _most(np_fn, np_max: int | None) -> int:
    """Matches that a pair must keep: the largest number that is averaged."""
    if np_fn is None:
        return NP_MIN + 1
    if np_max is None:
        raise ValueError("np_fn needs np_max, the largest number that it gives")
    return np_max


def _checked(n: Column, most: int) -> Column:
    return F.when(n > most, F.raise_error(F.lit(f"np_fn gives more than np_max = {most}"))).otherwise(n).cast("int")


def score_lss(templates: DataFrame, inputs: DataFrame, np_fn=None, np_max: int | None = None) -> DataFrame:
    """Mean of the np best distinct similarities (missing ones count zero)."""
    most = _most(np_fn, np_max)
    df = summaries(templates, inputs, most, distinct=True)
    return _top_mean(df, _checked(np_expr(F.col("n_i"), F.col("matched"), np_fn), most))


def score_lss_improved(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """Sum of the ten best distinct similarities over ten; summed in the task that matches."""
    df = summaries(templates, inputs, IMPROVED_TOP, distinct=True, finish=top_totals, schema=TOTALS_SCHEMA)
    return df.select(*PAIR, rounded(F.col("total") / (F.lit(IMPROVED_TOP) * F.lit(MILLION))).alias("score"))


def score_lss_threshold(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """Mean of all similarities above one half."""
    df = summaries(templates, inputs, sums="over").filter("over_n > 0")
    return df.select(*PAIR, rounded(F.col("over_sum") / (F.col("over_n") * F.lit(MILLION))).alias("score"))


def score_nb(templates: DataFrame, inputs: DataFrame, np_fn=None, np_max: int | None = None) -> DataFrame:
    """Mean of the n best similarities, repeats kept, n from both sizes."""
    most = _most(np_fn, np_max)
    df = summaries(templates, inputs, most)
    return _top_mean(df, _checked(np_expr(F.col("n_t"), F.col("n_i"), np_fn), most))


def lssr_pairs(templates: DataFrame, inputs: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Summaries with the matches that relaxation retains."""
    df = summaries(templates, inputs, half, shape=shape)
    nr = F.floor(F.least("n_i", "matched", 2 * F.size("top")) / 2)
    return df.withColumn("nr", nr.cast("int"))


def lssr_rho(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """``t_fpid, i_fpid, nr, rho_sum``: summed compatibilities of the matches that ``score_lssr`` relaxes.

    They are summed in the task that matches, or in blocks of matches if the
    probes are too large for that.
    """
    shape = probe_shape(inputs)
    if shape[1] > RHO_BLOCK:
        return rho_sums(lssr_pairs(templates, inputs, shape))
    sums = summaries(templates, inputs, half, finish=summed(half_retained), schema=SUMS_SCHEMA, shape=shape)
    return sums.select(*PAIR, "nr", rounded(F.col("s"), 3).alias("rho_sum"))


def _relaxation_scores(templates: DataFrame, inputs: DataFrame, top, retained) -> DataFrame:
    df = summaries(templates, inputs, top, finish=relaxed(retained), schema=SCORES_SCHEMA)
    return df.select(*PAIR, rounded(F.col("score"), 4).alias("score"))


def score_lssr(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """Relaxation over half as many matches as the smaller side has."""
    return _relaxation_scores(templates, inputs, half, half_retained)


def score_lssr_improved(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """Relaxation over as many matches as the smaller side has."""
    return _relaxation_scores(templates, inputs, every, all_retained)
