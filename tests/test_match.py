"""Matches found in single precision and cylinders built where they are matched, against dense similarities."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgemark import catalog
from ridgemark.operators import consolidate as C
from ridgemark.operators import cylinder as Y
from ridgemark.operators import jiang as J
from ridgemark.operators import relax
from ridgemark.plans import enrol as P
from ridgemark.settings import LOCAL_THRESHOLD, RHO_ANGLE, RHO_DIST
from ridgemark.sources import fixture as X
from results import rows


class Block:
    split = False

    def __init__(self, block):
        self.block = block

    def blocks(self):
        yield self.block


def _batch(prints):
    fields = ("idx", "x", "y", "th")
    return pa.record_batch({"fpid": [f for f, _ in prints], "minutiae": pa.array(
        [[dict(zip(fields, (k, *map(int, m)))) for k, m in enumerate(zip(*p))] for _, p in prints],
        pa.list_(pa.struct([(n, pa.int32()) for n in fields])))})


def _prints(seed, names):
    """Random prints; some minutiae are repeated, so that cylinders and similarities are equal."""
    r = np.random.default_rng(seed)
    for n, name in enumerate(names):
        size = 12 + 5 * (n % 4)
        p = np.array([r.integers(0, 120, size), r.integers(0, 120, size), r.integers(-40, 40, size)])
        yield name, np.hstack([p, p[:, :size // 2]]) if n % 2 else p


@pytest.mark.parametrize("top,distinct", [(0, False), (5, False), (5, True), (200, True), (Y.half, False)])
def test_best_matches_are_those_of_all_similarities(top, distinct, monkeypatch):
    t = _batch(list(_prints(1, "abcdefg")))
    i = pa.Table.from_batches(list(Y._feature_batches(True)([_batch(list(_prints(2, "pqrs")))]))).combine_chunks()
    probes = Y.prepared(i)
    monkeypatch.setattr(Y, "_EXACT_PAIRS", 7)
    monkeypatch.setattr(Y, "_CACHED_VALUES", 300)
    monkeypatch.setattr(Y, "_PRINT_LS", 30)
    found = {(r["t_fpid"], r["i_fpid"]): r for b in Y._summary_batches(Block(probes), top, distinct, True, Y._print_rows)([t]) for r in b.to_pylist()}
    over = {(r["t_fpid"], r["i_fpid"]): r for b in Y._summary_batches(Block(probes), 0, False, "over", Y._print_rows)([t]) for r in b.to_pylist()}
    seen = 0
    for rows_, side in Y._print_rows([t]):
        sl = Y.similarities(side, probes[2], 0, len(side.row))
        for row, name in enumerate(rows_["fpid"].to_pylist()):
            for p, probe in enumerate(probes[0].to_pylist()):
                own, cols = np.flatnonzero(side.row == row), np.flatnonzero(probes[2].row == p)
                part = sl[np.ix_(own, cols)]
                if not part.any():
                    assert (name, probe) not in found
                    continue
                seen += 1
                r = found[name, probe]
                above = part[part > LOCAL_THRESHOLD]
                assert (r["matched"], r["matches"], r["sl_sum"]) == ((part > 0).any(axis=1).sum(), (part > 0).sum(), part.sum())
                for sums in (r, over[name, probe]):
                    assert (sums["over_n"], sums["over_sum"]) == (len(above), above.sum())
                a, b = np.nonzero(part)
                want = sorted(zip(part[a, b], side.m["lsid"][own[a]], probes[2].m["lsid"][cols[b]]), reverse=True)
                if distinct:
                    want = [m for k, m in enumerate(want) if not k or want[k - 1][0] != m[0]]
                k = top(probes[1][p].as_py()) if callable(top) else top
                assert [(m["sl"], m["t_lsid"], m["i_lsid"]) for m in r["top"]] == want[:k]
    assert seen == len(found) == len(over) > 10


def test_cells_of_templates_never_leave_the_match(spark, sf_dir, monkeypatch):
    flat = X.template_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000012").cache()
    i = P.enrol(X.probe_minutiae(spark, sf_dir), X.ORDER, "cylinder", "input").cache()
    monkeypatch.setattr(P, "_TASK_MINUTIAE", 100)
    late = P.enrol_for_match(flat, X.ORDER, "cylinder")
    assert "minutiae" in late.columns and late.rdd.getNumPartitions() >= -(-flat.count() // 100) > 2
    early = P.enrol(flat, X.ORDER, "cylinder")
    large = P.enrol_for_match(flat, X.ORDER, "cylinder", limit=20)
    assert "ls" in large.columns
    for score in (C.score_nb, C.score_lss, C.score_lss_threshold):
        want = rows(score(early, i))
        assert rows(score(late, i)) == want and rows(score(large, i)) == want


def test_vectors_of_templates_never_leave_the_match(spark, sf_dir, monkeypatch):
    """One Python map from print rows to totals; equal scores for built and unbuilt templates."""
    plain = X.template_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000016").cache()
    # Fingerprints of few, far and repeated minutiae: structures are missing, out of range, or none is left.
    far = F.col("x") * F.when(F.col("fpid") == "Finger000000000009_1", 1_000_000).when(F.col("ln") == 1, 4000).otherwise(1)
    flat = plain.withColumn("x", far.cast("int")).filter("fpid != 'Finger000000000008_1' or ln = 2").cache()
    i = P.enrol(X.probe_minutiae(spark, sf_dir), X.ORDER, "jiang", "input").cache()
    monkeypatch.setattr(P, "_TASK_MINUTIAE", 100)
    late = P.enrol_for_match(flat, X.ORDER, "jiang", score="jiang_local")
    assert "minutiae" in late.columns and "ls" in P.enrol_for_match(flat, X.ORDER, "jiang").columns
    early = P.enrol(flat, X.ORDER, "jiang")
    assert early.agg(F.sum("n_ls")).first()[0] < flat.count() and early.count() < flat.select("fpid").distinct().count()
    assert "ls" in P.enrol_for_match(plain, X.ORDER, "jiang", 20, "jiang_local").columns    # oversized ones are built
    scores = C.score_jiang_local(late, i)
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = rows(C.score_jiang_local(early, i))
    assert len(want) > 20 and rows(scores) == want
    assert rows(J.jiang_matches(late, i)) == rows(J.jiang_matches(early, i))
    monkeypatch.setitem(C.MAX_BROADCAST_LS, "jiang", 5)        # probes beyond the bound
    assert rows(C.score_jiang_local(late, i)) == want


def test_queries_on_local_scores_need_one_python_worker_a_task(spark, sf_dir):
    """The scores that scores_round_trip, evaluate_from_text and the others read come from one Python map."""
    scores = catalog.local_scores(spark, sf_dir)
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_memory_of_the_neighbour_search_does_not_follow_the_batch():
    r = np.random.default_rng(3)
    offsets = np.arange(513) * 32
    x, y = r.integers(0, 240, offsets[-1]), r.integers(0, 320, offsets[-1])
    tracemalloc.start()
    J.nearest(x, y, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6


def _dense(m):
    """ρ of all matches of a pair from the definition."""
    def related(s):
        x, y, rad = (np.asarray(v, float) for v in (m[f"{s}_x"], m[f"{s}_y"], Y.radians_of(m[f"{s}_th"])))
        way = np.arctan2(y[:, :, None] - y[:, None, :], x[:, None, :] - x[:, :, None])
        return (np.hypot(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]),
                relax._turn(rad[:, :, None] - rad[:, None, :]), relax._turn(rad[:, :, None] - way))
    (td, tt, tw), (id_, it, iw) = related("t"), related("i")
    parts = (np.abs(td - id_), RHO_DIST), (np.abs(relax._turn(tt - it)), RHO_ANGLE), (np.abs(relax._turn(tw - iw)), RHO_ANGLE)
    return np.prod([relax._sigmoid(v, *how) for v, how in parts], axis=0)


def test_far_matches_are_compatible_with_nothing(monkeypatch):
    """Turns and directions are taken only where distances agree; the values are those of all pairs."""
    r = np.random.default_rng(5)
    m = {f"{s}_{c}": r.integers(lo, hi, (40, 9)) for s in "ti" for c, lo, hi in (("x", 0, 240), ("y", 0, 320), ("th", -128, 128))}
    for c in ("x", "y", "th"):
        m[f"i_{c}"][:10] = m[f"t_{c}"][:10]
    want = _dense(m)
    asked = []
    monkeypatch.setattr(relax.np, "arctan2", lambda y, x, f=np.arctan2: asked.append(y.size) or f(y, x))
    whole, part = relax.compatibility(m), relax.compatibility(m, slice(6, 20))
    assert (want > 1e-3).sum() > 100 and np.abs(whole - want).max() < 1e-12
    assert np.array_equal(part, whole[:, 6:])
    assert max(asked) < want.size / 2
