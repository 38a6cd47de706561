"""Registered features and consolidations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from results import rows

from ridgemark.operators import jiang, oversize
from ridgemark.plans import enrol as P
from ridgemark.plans import registry as R
from ridgemark.plans.identify import identify
from ridgemark.sources import fixture as X


@pytest.fixture(scope="module")
def sides(spark, sf_dir):
    """(whole, in chunks) vectors of four templates and six probes."""
    t = X.template_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000004").cache()
    q = X.probe_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000006").cache()
    whole = [P.enrol(side, X.ORDER, "jiang", role).cache() for side, role in ((t, "template"), (q, "input"))]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(oversize, "MAX_ROW_MINUTIAE", 8)
        parts = [P.enrol(side, X.ORDER, "jiang", limit=20).cache() for side in (t, q)]
        assert all(p.filter("n_chunks > 2").count() for p in parts)
    return whole, parts


def local_again(feature="jiang"):
    """The one-sided best similarities, with the best match of each template structure as a nested state."""
    kind = pa.list_(pa.struct([("t", pa.int32()), ("i", pa.int32()), ("sl", pa.int64())]))

    def listed(group, n, t, i, sl):
        order = np.lexsort((-i, -sl, t, group))
        group, t, i, sl = group[order], t[order], i[order], sl[order]
        first = np.ones(len(t), bool)
        first[1:] = (np.diff(group) != 0) | (np.diff(t) != 0)
        at = np.searchsorted(group[first], np.arange(n + 1)).astype(np.int32)
        fields = [pa.array(t[first].astype(np.int32)), pa.array(i[first].astype(np.int32)), pa.array(sl[first].astype(np.int64))]
        return {"best": pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, ["t", "i", "sl"])).cast(kind)}

    def flat(states):
        lists = states["best"]
        values = lists.flatten()
        group = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        return [group, *[values.field(n).to_numpy() for n in ("t", "i", "sl")]]

    def init(n):
        return {"best": pa.array([[]] * n, kind)}

    def update(states, m):
        group, t, i, sl = flat(states)
        return listed(np.append(group, m["pair"]), len(states["best"]), np.append(t, m["t_lsid"]), np.append(i, m["i_lsid"]),
                      np.append(sl, m["sl"]))

    def merge(states, group, n):
        at, t, i, sl = flat(states)
        return listed(group[at], n, t, i, sl)

    def finish(states, n_t, n_i):
        group, _, i, sl = flat(states)
        order = np.lexsort((-sl, i, group))
        group, i, sl = group[order], i[order], sl[order]
        first = np.ones(len(i), bool)
        first[1:] = (np.diff(group) != 0) | (np.diff(i) != 0)
        return np.bincount(group[first], sl[first], len(n_t)) / (n_t * 1e6)

    return R.Consolidation("local_again", feature, "best array<struct<t:int,i:int,sl:bigint>>", init, update, merge, finish)


@pytest.fixture
def added():
    R.register(local_again())
    yield
    R.unregister("local_again")


def test_a_nested_state_gives_the_built_in_scores(sides, added):
    want = rows(identify(*sides[0], "jiang", "jiang_local"))
    for whole in sides:
        assert rows(identify(*whole, "jiang", "local_again")) == want


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_states_merge_over_chunks_blocks_and_probe_parts(sides, added, monkeypatch, block):
    want = {name: rows(identify(*sides[0], "jiang", name)) for name in ("local_again", "mean_best")}
    small = R.Feature(**{**R.FEATURES["jiang"].__dict__, "bound": 12})
    monkeypatch.setitem(R.FEATURES, "jiang", small)         # probes in several blocks
    monkeypatch.setattr(jiang, "_BLOCK_PAIRS", block)       # and template rows in several updates
    for name, scores in want.items():
        assert rows(identify(*sides[1], "jiang", name)) == scores


def test_whole_fingerprints_need_no_exchange(sides, added):
    plan = identify(*sides[0], "jiang", "local_again")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan.split("InMemoryRelation")[0]
    plan = identify(*sides[1], "jiang", "local_again")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("RepartitionByExpression") == 1


def test_a_registered_feature(spark, sf_dir):
    """Structures that are minutiae; two match if they stand at one place."""
    def build(prints):
        ls = F.transform("minutiae", lambda m: F.struct(m["idx"].alias("lsid"), m["x"].alias("x"), m["y"].alias("y")))
        return prints.select("fpid", F.lit(0).alias("chunk"), F.lit(1).alias("n_chunks"), F.size("minutiae").cast("long").alias("n_ls"), ls.alias("ls"))

    def flat(column):
        values = column.flatten()
        return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), {n: values.field(n).to_numpy() for n in ("lsid", "x", "y")}

    def prepare(table):
        owner, m = flat(table["ls"].combine_chunks())
        return table["fpid"].combine_chunks(), table["n_ls"].combine_chunks(), owner, m

    def match(column, block):
        row, t = flat(column)
        _, _, owner, i = block
        a, b = np.nonzero((t["x"][:, None] == i["x"]) & (t["y"][:, None] == i["y"]))
        yield {"row": row[a], "probe": owner[b], "t_lsid": t["lsid"][a], "i_lsid": i["lsid"][b], "sl": np.full(len(a), 10**6)}

    R.register_feature(R.Feature("places", build, prepare, match, bound=40))
    R.register(local_again("places"))
    try:
        q = X.probe_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000006")
        own = P.enrol(q, X.ORDER, "places")
        got = {tuple(r)[:2]: r["score"] for r in identify(own, own, "places", "local_again").collect()}
        assert all(got[f, f] > 0 for f in {r["fpid"] for r in own.select("fpid").collect()})
        with pytest.raises(ValueError):
            identify(own, own, "jiang", "local_again")
        with pytest.raises(ValueError):
            P.enrol(q, X.ORDER, "places", limit=3).count()
    finally:
        R.unregister("local_again")
        R.unregister("places")


def test_names_are_checked():
    with pytest.raises(ValueError):
        R.register(R.MEAN_BEST)
    with pytest.raises(ValueError):
        R.register(local_again("unknown"))
    with pytest.raises(ValueError):
        R.register_feature(R.FEATURES["jiang"])
