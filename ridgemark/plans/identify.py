"""1:N identification: score templates against a probe set."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.operators import consolidate as C
from ridgemark.plans.registry import CONSOLIDATIONS, FEATURES, registered_scores

# Consolidation name → (feature kind it works on, function).
SCORES = {
    "jiang": ("jiang", C.score_jiang),
    "jiang_local": ("jiang", C.score_jiang_local),
    "lss": ("cylinder", C.score_lss),
    "lss_improved": ("cylinder", C.score_lss_improved),
    "lss_threshold": ("cylinder", C.score_lss_threshold),
    "lssr": ("cylinder", C.score_lssr),
    "lssr_improved": ("cylinder", C.score_lssr_improved),
    "nb": ("cylinder", C.score_nb),
}


def identify(templates: DataFrame, inputs: DataFrame, feature: str, score: str,
             threshold: float | None = 0.0, **options) -> DataFrame:
    """Scores ``t_fpid, i_fpid, score`` of the local-structure tables.

    Rows with a score above ``threshold`` are returned. A pair without a local
    match has no row. Consolidations of ``plans.registry`` are known by their names
    too. Other options go to the consolidation, which raises on
    names that it does not know.
    """
    if feature not in FEATURES:
        raise ValueError(f"unknown feature {feature!r}; one of {sorted(FEATURES)}")
    own = CONSOLIDATIONS.get(score)
    if own is None and score not in SCORES:
        raise ValueError(f"unknown consolidation {score!r}; one of {sorted([*SCORES, *CONSOLIDATIONS])}")
    kind = own.feature if own else SCORES[score][0]
    if kind != feature:
        raise ValueError(f"{score!r} consolidates {kind!r} features, not {feature!r}")
    if own:
        scores = registered_scores(templates, inputs, own, **options)
    else:
        scores = SCORES[score][1](templates, inputs, **options)
    return scores if threshold is None else scores.filter(F.col("score") > threshold)
