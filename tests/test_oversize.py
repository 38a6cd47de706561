"""The relational paths for very large fingerprints equal the narrow maps."""

import numpy as np
import pytest
from results import rows
from pyspark.sql import functions as F

from ridgemark.operators import align, consolidate, oversize
from ridgemark.plans import enrol as P
from ridgemark.plans.identify import identify
from ridgemark.sources import fixture as X

LIMIT = 30


@pytest.fixture(scope="module")
def crowd(spark):
    """Two fingerprints; the first has crowded and repeated positions."""
    rng = np.random.default_rng(7)
    made = []
    for fpid, n, span in (("A", 300, 60), ("B", 40, 250)):
        x, y = rng.integers(0, span, n), rng.integers(0, span, n)
        th = rng.integers(-128, 128, n)
        made += [(fpid, int(i), int(a), int(b), int(t), 9) for i, (a, b, t) in enumerate(zip(x, y, th))]
    made += [("A", 300 + i, 5, 5, -3, 9) for i in range(6)] + [("A", 306, 900, 900, 7, 9)]
    return spark.createDataFrame(made, "fpid string, at int, x int, y int, th int, q int").cache()


def test_numbering(crowd):
    got = oversize.number_minutiae(crowd, ["at", "x"]).join(crowd, ["fpid", "x", "y", "th"])
    assert got.filter("idx = at").select("fpid", "idx").distinct().count() == 347


def test_neighbours(crowd):
    assert rows(P.neighbours(crowd, ["at"], limit=LIMIT)) == rows(P.neighbours(crowd, ["at"]))


def test_hull(crowd):
    assert rows(P.hull_edges(crowd, ["at"], limit=LIMIT)) == rows(P.hull_edges(crowd, ["at"]))


def _flat(df):
    return df.select("fpid", "n_ls", F.inline("ls"))


def test_jiang_features(crowd, monkeypatch):
    monkeypatch.setattr(oversize, "MAX_ROW_MINUTIAE", 50)
    chunked = P.enrol(crowd, ["at"], "jiang", limit=LIMIT)
    assert chunked.filter("fpid = 'A'").count() == 7
    assert rows(_flat(chunked)) == rows(_flat(P.enrol(crowd, ["at"], "jiang")))


@pytest.mark.parametrize("role", ["template", "input"])
def test_cylinder_features(crowd, role, monkeypatch):
    monkeypatch.setattr(oversize, "MAX_ROW_MINUTIAE", 50)
    chunked = _flat(P.enrol(crowd, ["at"], "cylinder", role, limit=LIMIT)).toPandas()
    whole = _flat(P.enrol(crowd, ["at"], "cylinder", role)).toPandas()
    key = ["fpid", "lsid"]
    chunked, whole = (d.sort_values(key).reset_index(drop=True) for d in (chunked, whole))
    assert (chunked[key + ["n_ls", "x", "y", "th"]] == whole[key + ["n_ls", "x", "y", "th"]]).all().all()
    assert np.allclose(np.stack(chunked["cm"]), np.stack(whole["cm"]), atol=1e-6)
    assert np.allclose(chunked["norm"], whole["norm"], atol=1e-5)


@pytest.fixture(scope="module")
def sides(spark, sf_dir):
    """Four fingers as templates and six probes."""
    t = X.template_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000004").cache()
    q = X.probe_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000006").cache()
    return t, q


@pytest.fixture(scope="module")
def cylinder_sides(sides):
    """(whole, chunked) cylinder tables of the same templates and probes."""
    t, q = sides
    whole = P.enrol(t, X.ORDER, "cylinder").cache(), P.enrol(q, X.ORDER, "cylinder", "input").cache()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(oversize, "MAX_ROW_MINUTIAE", 8)
        parts = (P.enrol(t, X.ORDER, "cylinder", limit=20).cache(),
                 P.enrol(q, X.ORDER, "cylinder", "input", limit=20).cache())
    assert all(p.filter("n_chunks > 1").count() for p in parts)
    return whole, parts


@pytest.mark.parametrize("score", ["lss", "lss_improved", "lss_threshold", "nb", "lssr", "lssr_improved"])
def test_chunked_templates_and_probes_score_the_same(cylinder_sides, score):
    want, got = ({r[:2]: r[2] for r in identify(*side, "cylinder", score).select(
        "t_fpid", "i_fpid", "score").collect()} for side in cylinder_sides)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 2e-4 for k in want)


@pytest.mark.parametrize("score", ["jiang", "jiang_local"])
def test_chunked_neighbourhood_templates_score_the_same(sides, score, monkeypatch):
    t, q = sides
    whole = rows(identify(P.enrol(t, X.ORDER, "jiang"), P.enrol(q, X.ORDER, "jiang", "input"), "jiang", score))
    monkeypatch.setattr(oversize, "MAX_ROW_MINUTIAE", 8)
    parts = [P.enrol(side, X.ORDER, "jiang", limit=20).cache() for side in (t, q)]
    assert all(p.filter("n_chunks > 1").count() for p in parts)
    assert rows(identify(*parts, "jiang", score)) == whole


def test_large_probe_sets(sides, monkeypatch):
    t, q = sides
    jt, jq = P.enrol(t, X.ORDER, "jiang"), P.enrol(q, X.ORDER, "jiang", "input")
    small = rows(identify(jt, jq, "jiang", "jiang"))
    monkeypatch.setitem(align.MAX_BROADCAST_LS, "jiang", 10)
    assert rows(identify(jt, jq, "jiang", "jiang")) == small
    ct, cq = P.enrol(t, X.ORDER, "cylinder"), P.enrol(q, X.ORDER, "cylinder", "input")
    one = consolidate.cylinder_summaries(ct, cq, 5, True)
    many = consolidate.cylinder_summaries(ct, cq, 5, True, bound=100)
    assert rows(one) == rows(many)
