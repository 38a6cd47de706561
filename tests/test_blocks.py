"""Probe stores walked block by block, order statistics and one-to-one matching."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from results import rows

from ridgemark.operators import align, oversize
from ridgemark.operators.cylinder import cylinder_summaries
from ridgemark.operators.jiang import jiang_matches
from ridgemark.operators.probes import probe_tables
from ridgemark.plans import enrol as P
from ridgemark.plans import evaluate as E
from ridgemark.plans.identify import identify
from ridgemark.settings import MAX_BROADCAST_LS
from ridgemark.sources import fixture as X


@pytest.fixture(scope="module")
def sides(spark, sf_dir):
    """Four fingers as templates and six probes, in whole rows and in chunks of eight structures."""
    t = X.template_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000004").cache()
    q = X.probe_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000006").cache()
    made = {}
    for kind in ("jiang", "cylinder"):
        made[kind, "whole"] = P.enrol(t, X.ORDER, kind).cache(), P.enrol(q, X.ORDER, kind, "input").cache()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(oversize, "MAX_ROW_MINUTIAE", 8)
            made[kind, "parts"] = (P.enrol(t, X.ORDER, kind, limit=20).cache(), P.enrol(q, X.ORDER, kind, "input", limit=20).cache())
            assert all(p.filter("n_chunks > 2").count() for p in made[kind, "parts"])
    return made


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("score", ["lss", "lss_improved", "lss_threshold", "nb", "lssr", "lssr_improved"])
def test_a_probe_beyond_the_bound_is_split(sides, score, monkeypatch):
    want = rows(identify(*sides["cylinder", "parts"], "cylinder", score))
    monkeypatch.setitem(MAX_BROADCAST_LS, "cylinder", 12)
    assert rows(identify(*sides["cylinder", "parts"], "cylinder", score)) == want


def test_any_number_of_blocks_is_one_scan(spark, sides, tmp_path):
    for kind, find in (("jiang", jiang_matches), ("cylinder", cylinder_summaries)):
        t, i = sides[kind, "whole"]
        t.write.parquet(f"{tmp_path}/{kind}")
        t = spark.read.parquet(f"{tmp_path}/{kind}")
        for bound in (10, 60, 10**6):
            found = find(t, i, bound=bound)
            assert _plan(found).count(" parquet") == 1
            assert rows(found.drop("hits")) == rows(find(t, i).drop("hits"))


def test_probe_tables_keep_probes_whole():
    r = random.Random(3)
    sizes = [(f"p{k:02}", [r.randint(0, 8) for _ in range(r.randint(1, 6))]) for k in range(40)]
    flat = [(name, k, sum(parts), [{"lsid": 1}] * n) for name, parts in sizes for k, n in enumerate(parts)]
    table = pa.table({"fpid": [f[0] for f in flat], "chunk": [f[1] for f in flat], "n_ls": [f[2] for f in flat], "ls": [f[3] for f in flat]})
    tables = list(probe_tables(table.to_batches(7), 20))
    assert pa.concat_tables(tables).to_pylist() == table.to_pylist()
    for t in tables:
        assert sum(map(len, t["ls"].to_pylist())) <= 20
    where = {}
    for n, t in enumerate(tables):
        for name in t["fpid"].to_pylist():
            where.setdefault(name, set()).add(n)
    assert all(len(where[name]) == 1 for name, parts in sizes if sum(parts) <= 20)


def test_matching_is_once_in_the_box_join(sides, monkeypatch):
    t, i = sides["jiang", "whole"]
    found = align.box_matches(t, i)
    assert "MapInArrow run(" not in _plan(found)                 # seeds are cut off
    monkeypatch.setattr(align, "HEAVY_SEED", 1)
    assert rows(align.box_matches(t, i)) == rows(found)


@pytest.mark.parametrize("salts", [4096, 1])
def test_box_matches_of_whole_fingerprints_meet_without_a_join(sides, salts, monkeypatch):
    t, i = sides["jiang", "whole"]
    found = align.box_matches(t, i)
    assert "Join" not in _plan(found) and found.columns == align.joined_boxes(t, i).columns
    monkeypatch.setattr(align, "HEAVY_SEED", salts)
    assert rows(found) == rows(align.joined_boxes(t, i)) == rows(align.box_matches(sides["jiang", "parts"][0], i))


def test_one_to_one_is_greedy():
    r = np.random.default_rng(8)
    for _ in range(50):
        n, groups = int(r.integers(0, 200)), 4
        group = r.integers(0, groups, n)
        t, i = r.integers(0, 12, n), r.integers(0, 12, n)
        pairs = np.unique(np.stack([group, t, i]), axis=1)
        group, t, i = pairs
        weight = r.integers(1, 6, len(t))
        got = align.one_to_one(group, group * 12 + t, group * 12 + i, (i, t), weight, groups)
        for g in range(groups):
            used, total = set(), 0
            for w, a, b in sorted(zip(weight[group == g], t[group == g], i[group == g]), reverse=True):
                if ("t", a) not in used and ("i", b) not in used:
                    used |= {("t", a), ("i", b)}
                    total += w
            assert got[g] == total


@pytest.mark.parametrize("values", [[0.5] * 40, [k / 7 for k in range(100)], [1e300, *[k / 1000 for k in range(90)]],
                                    [0.1] * 50 + [0.2], [0.25]])
def test_threshold_is_exact_for_any_distribution(spark, values):
    scores = spark.createDataFrame([(f"t{k}", f"i{k}", float(v)) for k, v in enumerate(values)], "t_fpid string, i_fpid string, score double")
    none = spark.createDataFrame([], "i_fpid string")
    for far in (0.0, 0.2, 0.5, 0.99, 1.0):
        p = math.floor((1 - far) * len(values))
        want = sorted(values)[p - 1] if p >= 1 else 0.0
        assert E.threshold_at_far(scores, none, far).first()["threshold"] == want


def test_an_outlier_does_not_send_scores_to_one_range(spark):
    scores = spark.range(20000).select((F.col("id") / 20000).alias("score")).unionByName(
        spark.range(1).select(F.lit(1e300).alias("score")))
    cuts = E._cuts(scores)
    sizes = scores.join(F.broadcast(cuts)).groupBy(E._range()).count().agg(F.max("count")).first()[0]
    assert sizes < 20000 / 50


def test_positions_of_scores(spark):
    r = random.Random(2)
    data = [(f"t{k}", f"i{k % 7}", r.choice([0.5, 0.5, r.random()])) for k in range(500)]
    scores = spark.createDataFrame(data, "t_fpid string, i_fpid string, score double").repartition(6)
    got = [(p["score"], p["i_fpid"], p["t_fpid"]) for p in sorted(E.positions(scores).collect(), key=lambda p: p["position"])]
    assert got == sorted((s, i, t) for t, i, s in data)
    assert E.positions(scores.limit(0)).count() == 0
