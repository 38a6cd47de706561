"""Consolidations against brute force, and the flow enrol → match → evaluate."""

import itertools
import os
import subprocess
import sys

import numpy as np
import pytest
from results import rows
from pyspark.sql import functions as F

from ridgemark.catalog import QUERIES
from ridgemark.operators import consolidate
from ridgemark.operators.jiang import best_per_template, jiang_matches
from ridgemark.operators import relax as relax_module
from ridgemark.operators.relax import relax
from ridgemark.plans import evaluate as E
from ridgemark.plans import store
from ridgemark.plans.enrol import build_local_structures, enrol
from ridgemark.plans.identify import SCORES, identify
from ridgemark.settings import MAX_BROADCAST_LS
from ridgemark.sources import fixture as X
from ridgemark.sources.minutiae import group_minutiae, merge_records, parse_minutiae, union_prints
from ridgemark.sources.scores import parse_scores


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    t, q = X.template_minutiae(spark, sf_dir), X.probe_minutiae(spark, sf_dir)
    made = {kind: (enrol(t, X.ORDER, kind).cache(), enrol(q, X.ORDER, kind, "input").cache())
            for kind in ("jiang", "cylinder")}
    return made


@pytest.fixture(scope="module")
def scores(data):
    return {name: identify(*data[kind], kind, name).cache() for name, (kind, _) in SCORES.items()}


@pytest.mark.parametrize("name", sorted(SCORES))
def test_every_enrolled_probe_is_found(scores, spark, sf_dir, name):
    genuines = X.probe_lists(spark, sf_dir)[0]
    own = scores[name].join(genuines, "i_fpid", "left_semi")
    assert E.true_positives(own, "sfinge").first()["tp"] == genuines.count() == 15


def _structures(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["fpid"], []).extend(r["ls"])
    return out


def _cylinder_matches(t_ls, i_ls):
    """All positive similarities (sl, t, i) of one pair, cell by cell."""
    found = []
    for t, i in itertools.product(t_ls, i_ls):
        if min(t["norm"], i["norm"]) < 0 or abs((t["th"] - i["th"] + 128) % 256 - 128) > 64:
            continue
        a, b = np.array(t["cm"], np.float64), np.array(i["cm"], np.float64)
        both = (a >= 0) & (b >= 0)
        if both.sum() < 230:
            continue
        sl = 1 - np.sqrt(((a - b)[both] ** 2).sum()) / (t["norm"] + i["norm"])
        if np.floor((sl + 1e-9) * 1e6 + 0.5) > 0:
            found.append((int(np.floor((sl + 1e-9) * 1e6 + 0.5)), t["lsid"], i["lsid"]))
    return sorted(found, reverse=True)


def test_cylinder_scores_by_brute_force(data, scores):
    t, i = (_structures(d.filter(F.col("fpid") < "Finger000000000003")) for d in data["cylinder"])
    got = {n: {(r["t_fpid"], r["i_fpid"]): r["score"] for r in scores[n].collect()}
           for n in ("lss", "lss_improved", "lss_threshold", "nb")}
    for tf, qf in itertools.product(t, i):
        m = _cylinder_matches(t[tf], i[qf])
        sl = [x[0] for x in m]
        distinct = sorted(set(sl), reverse=True)
        matched = len({x[1] for x in m})
        n_lss = 4 if min(matched, len(i[qf])) < 20 else 5
        n_nb = 4 if min(len(t[tf]), len(i[qf])) < 20 else 5
        over = [v for v in sl if v > 500_000]
        want = {"lss": sum(distinct[:n_lss]) / n_lss, "lss_improved": sum(distinct[:10]) / 10,
                "lss_threshold": np.mean(over) if over else None, "nb": sum(sl[:n_nb]) / n_nb}
        for name, value in want.items():
            assert got[name].get((tf, qf)) == (None if value is None else pytest.approx(value / 1e6, abs=2e-6))


def test_relaxation_by_loop():
    rng = np.random.default_rng(3)
    m = {n: rng.integers(0, 200, (4, 6)) for n in ("t_x", "t_y", "i_x", "i_y")}
    m.update({n: rng.integers(-128, 128, (4, 6)) for n in ("t_th", "i_th")}, sl=rng.integers(1, 10**6, (4, 6)))
    nr, n_p = np.array([6, 3, 1, 2]), np.array([4, 5, 4, 4])
    got = relax(m, nr, n_p)

    def wrap(d):
        return d + 2 * np.pi if d < -np.pi else d - 2 * np.pi if d >= np.pi else d

    def psi(v, mu, tau):
        return 1 / (1 + np.exp(tau * (mu - v)))

    def side(p, s, a, b):
        x, y = m[f"{s}_x"][p], m[f"{s}_y"][p]
        rad = ((m[f"{s}_th"][p] + 128) * 360 // 256) * 0.017453293
        return (np.hypot(x[a] - x[b], y[a] - y[b]), wrap(rad[a] - rad[b]),
                wrap(rad[a] - np.arctan2(float(y[a] - y[b]), float(x[b] - x[a]))))

    for p in range(4):
        n = nr[p]
        value = start = m["sl"][p][:n] / 1e6
        for _ in range(5 if n > 1 else 0):
            fresh = []
            for a in range(n):
                total = 0
                for b in range(n):
                    if a != b:
                        (d1, u1, r1), (d2, u2, r2) = side(p, "t", a, b), side(p, "i", a, b)
                        total += value[b] * psi(abs(d1 - d2), 5, -1.6) * psi(
                            abs(wrap(u1 - u2)), 0.261799387799, -30) * psi(abs(wrap(r1 - r2)), 0.261799387799, -30)
                fresh.append(0.5 * value[a] + 0.5 / (n - 1) * total)
            value = np.array(fresh)
        k = min(n_p[p], n)
        best = sorted(range(n), key=lambda j: (value[j] / start[j], j), reverse=True)[:k]
        assert got[p] == pytest.approx(np.mean([value[j] for j in best]))


def test_probe_blocks_equal_the_whole_set(data):
    """Small bounds split the probe set, and large probes, over several blocks."""
    t, i = data["jiang"]
    whole = jiang_matches(t, i)
    assert rows(jiang_matches(t, i, bound=100)) == rows(whole)
    best = best_per_template(whole)
    for bound in (100, 10**6):
        assert rows(jiang_matches(t, i, best=True, bound=bound).select(best.columns)) == rows(best)


def test_scores_of_probe_blocks(data, scores, monkeypatch):
    monkeypatch.setitem(MAX_BROADCAST_LS, "jiang", 100)
    for name in ("jiang", "jiang_local"):
        assert rows(identify(*data["jiang"], "jiang", name)) == rows(scores[name])


def test_relaxation_of_large_pairs_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    n = 40
    m = {k: rng.integers(0, 300, n) for k in ("t_x", "t_y", "i_x", "i_y")}
    m.update({k: rng.integers(-128, 128, n) for k in ("t_th", "i_th")}, sl=rng.integers(1, 10**6, n))
    want = relax({k: v[None] for k, v in m.items()}, np.array([n]), np.array([5]))[0]
    monkeypatch.setattr(relax_module, "_BLOCK_VALUES", 200)
    assert relax_module._relax_rows(m, n, 5) == pytest.approx(want, rel=1e-9)


def test_relaxation_of_twenty_thousand_matches_is_bounded():
    """One block of rows at a time: the largest array stays near the block size."""
    import tracemalloc
    rng = np.random.default_rng(5)
    n = 10_000                      # half of 20,000 minutiae are relaxed
    m = {k: rng.integers(0, 5000, n) for k in ("t_x", "t_y", "i_x", "i_y")}
    m.update({k: rng.integers(-128, 128, n) for k in ("t_th", "i_th")}, sl=rng.integers(1, 10**6, n))
    own = {k: v[None] for k, v in m.items()}
    tracemalloc.start()
    relax_module.compatibility(own, slice(0, relax_module._BLOCK_VALUES // n))
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_scores_do_not_depend_on_partitioning(data, scores):
    for name in ("jiang_local", "lss", "lssr_improved"):
        kind = SCORES[name][0]
        t, i = data[kind]
        assert rows(identify(t.repartition(7), i.repartition(3), kind, name)) == rows(scores[name])


def test_a_fingerprint_matches_itself(data):
    t = data["jiang"][0].filter("fpid = 'Finger000000000004_1'")
    got = identify(t, t, "jiang", "jiang_local").first()["score"]
    assert got == 1.0
    c = data["cylinder"][0].filter("fpid = 'Finger000000000004_1'")
    # Equal similarities of one collapse, so only one of the five best is exact.
    assert identify(c, c, "cylinder", "nb").first()["score"] == 1.0


def test_validation_of_names_and_options(data):
    t, i = data["jiang"]
    with pytest.raises(ValueError):
        identify(t, i, "jiang", "lss")
    with pytest.raises(ValueError):
        identify(t, i, "jiang", "none")
    with pytest.raises(TypeError):
        identify(t, i, "jiang", "jiang_local", np_mx=3)
    with pytest.raises(ValueError):
        identify(*data["cylinder"], "cylinder", "lss", np_fn=lambda n: n)


def test_wide_averages_use_all_their_matches(data):
    """Averaging up to 12 matches gives what the listed matches say."""
    t, i = data["cylinder"]
    wide = {"np_fn": lambda n: F.least(n, F.lit(12)), "np_max": 12}
    got = {r[:2]: r["score"] for r in identify(t, i, "cylinder", "nb", **wide).select("t_fpid", "i_fpid", "score").collect()}
    for r in consolidate.summaries(t, i, 12).select("t_fpid", "i_fpid", "n_t", "n_i", "top").collect():
        n = min(r["n_t"], r["n_i"], 12)
        want = sum(m["sl"] for m in r["top"][:n]) / n / 1e6
        assert abs(got.get((r["t_fpid"], r["i_fpid"]), 0) - want) < 2e-6


def test_repeated_ids_are_one_finger(spark, sf_dir):
    prints = group_minutiae(X.template_minutiae(spark, sf_dir), X.ORDER).filter("fpid < 'Finger000000000004'")
    halves = [prints.withColumn("minutiae", F.filter("minutiae", lambda m: m["idx"] % 2 == k)) for k in (0, 1)]
    merged = merge_records(union_prints(*halves))
    assert [r["n"] for r in merged.orderBy("fpid").collect()] == [r["n"] for r in prints.orderBy("fpid").collect()]
    assert rows(merged.select(F.expr("array_sort(transform(minutiae, m -> m.idx)) as i"))) == rows(
        prints.select(F.expr("array_sort(transform(minutiae, m -> m.idx)) as i")))
    for kind in ("jiang", "cylinder"):
        built = build_local_structures(union_prints(*halves), kind)
        assert built.groupBy("fpid").count().filter("count > 1").count() == 0


def test_bad_angles_reject_their_fingerprint_only(spark):
    lines = spark.createDataFrame([(f"F{k}:1 2 {a} 4",) for k, a in enumerate(
        ("1e30", "Infinity", "-Infinity", "NaN", "400", "90"))], "value string")
    good, bad = parse_minutiae(lines)
    assert [r["fpid"] for r in good.collect()] == ["F5"] and bad.count() == 5


def test_print_rows_enrol_like_flat_minutiae(spark, sf_dir, data):
    prints = group_minutiae(X.template_minutiae(spark, sf_dir), X.ORDER)
    assert rows(build_local_structures(prints, "jiang")) == rows(data["jiang"][0])
    some = prints.filter(F.col("fpid") < "Finger000000000003")
    assert rows(build_local_structures(some, "jiang", limit=5).select("fpid", F.inline("ls"))) == rows(
        build_local_structures(some, "jiang").select("fpid", F.inline("ls")))


def test_stores_and_sinks(spark, data, scores, tmp_path):
    t, i = data["cylinder"]
    store.write_templates(t, f"{tmp_path}/t")
    store.write_inputs(i, f"{tmp_path}/i")
    store.write_inputs(i, f"{tmp_path}/i")
    again = identify(store.read_structures(spark, f"{tmp_path}/t"), store.read_structures(spark, f"{tmp_path}/i"),
                     "cylinder", "lss")
    assert rows(again) == rows(scores["lss"])
    local = scores["jiang_local"]
    for fmt in ("mapreduce", "rdd"):
        store.write_scores(local, f"{tmp_path}/{fmt}", fmt)
        assert rows(parse_scores(spark.read.text(f"{tmp_path}/{fmt}"), fmt)[0]) == rows(local)
    store.write_scores(local, f"{tmp_path}/sorted", ordered=True)
    assert rows(spark.read.parquet(f"{tmp_path}/sorted")) == rows(local)
    store.write_details(E.detailed(local, "sfinge"), f"{tmp_path}/d")
    assert spark.read.csv(f"{tmp_path}/d", sep="\t").count() == local.count()


TABLE = [("0", "0", 0.9), ("0", "20", 0.4), ("10", "20", 0.8), ("10", "10", 0.7),
         ("5", "0", 0.5), ("5", "20", 0.1), ("15", "10", 0.6)]


def test_evaluation(spark):
    name = "Finger{:06d}_{}".format
    scores = spark.createDataFrame([(name(int(i), 2), name(int(t), 1), s) for i, t, s in TABLE],
                                   "i_fpid string, t_fpid string, score double")
    genuines = spark.createDataFrame([(name(0, 2),), (name(10, 2),)], "i_fpid string")
    own, other = E.split_scores(scores, genuines)
    assert (own.count(), other.count()) == (4, 3)
    assert E.true_positives(own, "sfinge").first()["tp"] == 1
    assert [E.threshold_at_far(scores, genuines, far).first()[0] for far in (0.0, 0.5, 1.0)] == [0.6, 0.5, 0.0]
    assert E.threshold_at_far(scores, genuines, 0.5, "min").first()[0] == 0.1
    result = E.evaluate(scores, genuines, "sfinge").first()
    assert (result["threshold"], result["tp"], result["fn"], result["fnr"]) == (0.6, 1, 1, 0.5)
    assert E.evaluate(scores, genuines, "sfinge", far=None).first()["tp"] == 1
    tied = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.5)], "i_fpid string, t_fpid string, score double")
    assert E.rank1(tied).first()["t_fpid"] == "b"


@pytest.mark.parametrize("impostors", [["5"], ["5", "15", "25"]])
def test_threshold_of_equal_impostor_scores(spark, impostors):
    scores = spark.createDataFrame([("0", "0", 0.9), *[(i, "0", 0.5) for i in impostors]], "i_fpid string, t_fpid string, score double")
    genuines = spark.createDataFrame([("0",)], "i_fpid string")
    for agg in ("max", "min"):
        assert E.threshold_at_far(scores, genuines, 0.0, agg).first()[0] == 0.5
    assert E.threshold_at_far(scores, genuines, 1.0).first()[0] == 0.0


def test_registered_queries_have_unique_columns(spark, sf_dir):
    assert len(QUERIES) >= 36
    for name in ("knn_neighbours", "score_nb_wide", "evaluate_from_text", "angle_functions", "fnr_at_far"):
        columns = QUERIES[name](spark, sf_dir).columns
        assert len(columns) == len(set(columns)), name


def test_queries_run_from_another_folder(tmp_path):
    """Workers get the package from the session, not from the folder of the driver."""
    code = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("rows", entry.entry(spark).count(), entry.queries()["cylinder_cells"](spark, {data!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code.format(root=root, data="/root/testdata/sf0.001")], cwd=tmp_path,
                          env=env, capture_output=True, text=True, timeout=300)
    assert "rows 25 6000" in done.stdout, done.stderr[-2000:]
