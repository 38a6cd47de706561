"""Scores that are finished in the task that matches, against those of summaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgemark import catalog
from ridgemark.functions.numeric import rounded
from ridgemark.operators import consolidate as C
from ridgemark.operators import cylinder as Y
from ridgemark.operators import relax
from ridgemark.plans import enrol as P
from ridgemark.operators import oversize
from ridgemark.sources import fixture as X
from results import rows


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def sides(spark, sf_dir):
    flat = X.template_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000010").cache()
    i = P.enrol(X.probe_minutiae(spark, sf_dir), X.ORDER, "cylinder", "input").cache()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(oversize, "MAX_ROW_MINUTIAE", 8)
        chunked = P.enrol(flat, X.ORDER, "cylinder", limit=30).cache()
        assert 0 < chunked.filter("n_chunks > 1").count()
        yield P.enrol_for_match(flat, X.ORDER, "cylinder"), chunked, i


def _same(got, want, within):
    got, want = ({r[:2]: r[2:] for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(got) > 30
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=within)


def test_compatibilities_are_summed_where_matches_are_found(sides, monkeypatch):
    """no match passes from Python to Spark and back; equal sums by blocks of matches."""
    late, chunked, i = sides
    got = C.lssr_rho(late, i)
    assert _plan(got).count("MapInArrow") == 1 and "top" not in _plan(got)
    want = relax.rho_sums(C.lssr_pairs(late, i), 40)
    _same(got, want, 1e-6)
    _same(C.lssr_rho(chunked, i), want, 1e-6)
    monkeypatch.setattr(C, "RHO_BLOCK", 5)
    _same(C.lssr_rho(late, i), want, 1e-6)


def test_relaxed_scores_are_finished_where_matches_are_found(sides):
    """one Python map from print rows to scores."""
    late, chunked, i = sides
    got = C.score_lssr(late, i)
    assert _plan(got).count("MapInArrow") == 1 and "top" not in _plan(got)
    _same(C.score_lssr(chunked, i), got, 2e-4)


def test_best_ten_are_summed_where_matches_are_found(sides):
    """only a sum of each pair leaves the map."""
    late, chunked, i = sides
    got = C.score_lss_improved(late, i)
    assert _plan(got).count("MapInArrow") == 1 and "top" not in _plan(got)
    df = C.summaries(late, i, 10, distinct=True)
    want = df.select("t_fpid", "i_fpid", rounded(F.aggregate("top", F.lit(0).cast("bigint"), lambda s, m: s + m["sl"]) / 1e7))
    assert rows(got) == rows(want.toDF("t_fpid", "i_fpid", "score")) == rows(C.score_lss_improved(chunked, i))


def test_all_similarities_are_taken_once(monkeypatch):
    """with sums, cells are multiplied once, in double precision; a cylinder without norm meets nothing."""
    r = np.random.default_rng(8)
    made = []
    for n in (40, 33):
        norm = r.uniform(1, 4, n)
        norm[:3] = 0
        active = r.uniform(0, 0.3, (n, len(Y.ACTIVE), Y.LEVELS)).astype(np.float32)
        active[:3] = 0
        active[r.random((n, len(Y.ACTIVE))) < 0.1] = -1
        m = {"lsid": np.arange(n, dtype=np.int32), "norm": norm, "th": r.integers(-100, 100, n).astype(np.int32)}
        made.append(Y.Side.of(np.sort(r.integers(0, 4, n)), m, active))
    t, i = made
    want = Y.similarities(t, i, 5, 40)
    probes = np.unique(i.row)
    sums = Y._Sums(i.row, probes, 35)
    monkeypatch.setattr(Y, "_CACHED_VALUES", 200)
    monkeypatch.setattr(Y.Side, "narrow_factors", None)
    shares = Y._Meeting(t, i, 5, 40, True, sums.add).shares
    assert np.array_equal(shares < 1, want > 0) and 100 < (want > 0).sum() < want.size
    over = want > Y.LOCAL_THRESHOLD
    for got, values in zip(sums.found, (want > 0, want, over, want * over)):
        assert np.array_equal(got, np.stack([values[:, i.row == p].sum(axis=1) for p in probes], axis=1))


def test_points_inside_are_no_vertices():
    r = np.random.default_rng(2)
    prints = [np.zeros((1, 2)), np.ones((5, 2)), np.array([(0, 0), (9, 9), (4, 4)]), np.array([(0, 0), (0, 9), (0, 4), (0, 9)])]
    prints += [r.integers(0, size, (n, 2)) for n in (3, 8, 30, 300) for size in (2, 6, 300)]
    prints = [p.astype(np.int64) for p in prints]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in prints])])
    x, y = np.concatenate(prints).T
    for p, got in zip(prints, Y._hulls(x, y, offsets)):
        assert np.array_equal(got, Y.hull_vertices(*p.T))


def test_improved_relaxation_takes_as_many_matches_as_the_smaller_side(sides):
    """not only half of the probe's number of them."""
    late, chunked, i = sides
    want, most = {}, 0
    for r in C.summaries(late, i, 10_000).collect():
        nr, n_p = min(r["n_i"], r["matched"]), 4 + (min(r["n_i"], r["matched"]) >= 20)
        assert nr <= len(r["top"])
        m = {n: np.array([[e[n] for e in r["top"][:nr]]]) for n in relax._FIELDS}
        want[r["t_fpid"], r["i_fpid"]] = relax.relax(m, np.array([nr]), np.array([n_p]))[0]
        most += nr > r["n_i"] // 2
    assert most > len(want) / 2 > 15
    for templates in (late, chunked):
        got = {(r["t_fpid"], r["i_fpid"]): r["score"] for r in C.score_lssr_improved(templates, i).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(v, abs=2e-4) for k, v in want.items())


def test_queries_finish_in_the_match(spark, sf_dir):
    for name in ("lssr_rho", "score_lssr", "score_lss_improved"):
        plan = _plan(catalog.QUERIES[name](spark, sf_dir))
        assert plan.count("MapInArrow") == 1 and "i_th" not in plan


@pytest.mark.parametrize("sizes", [[14, 13, 0, 12, 14], [1, 0, 400, 2], [0, 0], []])
def test_candidates_are_sorted_by_group(sizes):
    r = np.random.default_rng(4)
    group = np.repeat(np.arange(len(sizes)), sizes)
    key = r.permutation(len(group)).astype(np.int64) + 1
    for mixed in (np.arange(len(group)), r.permutation(len(group))):
        g, k = group[mixed], key[mixed]
        assert np.array_equal(Y._by_group(g, k, len(sizes)), np.lexsort((-k, g)))
