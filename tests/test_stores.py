"""Lookups, metrics, text forms and merged records."""

import random

import pytest
from pyspark.sql import functions as F
from results import rows

from ridgemark.functions import codec
from ridgemark.operators import jiang, oversize
from ridgemark.operators.cylinder import flat_cylinders
from ridgemark.plans import enrol as P
from ridgemark.plans import store
from ridgemark.plans.metrics import Metrics
from ridgemark.sources import fixture as X
from ridgemark.sources.minutiae import parse_prints


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return P.enrol(X.template_minutiae(spark, sf_dir), X.ORDER, "jiang").cache()


def _rows_of_scan(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_lookup_skips_row_groups(spark, tmp_path):
    vectors = P.enrol(X.template_minutiae(spark, "/root/testdata/sf0.01"), X.ORDER, "jiang").cache()
    path = f"{tmp_path}/store"
    store.write_lookup(vectors, path, block_bytes=4096)
    table = store.read_structures(spark, path)
    wanted = ["Finger000000000007_1", "Finger000000000150_1", "nobody", None]
    found = store.lookup(table, wanted)
    assert rows(found) == rows(vectors.filter(F.col("fpid").isin(wanted[:2])))
    assert "PushedFilters: [In(fpid" in found._jdf.queryExecution().executedPlan().toString()
    assert _rows_of_scan(found) < table.count() / 4
    inside = store.lookup(table, ["Finger000000000007_x"])         # between stored ids: only the Bloom filter can tell
    assert inside.count() == 0 and _rows_of_scan(inside) == 0
    many = spark.createDataFrame([(f"Finger{k:012}_1",) for k in range(0, 3000, 2)], "fpid string")
    assert rows(store.lookup(table, many)) == rows(table.join(many, "fpid", "left_semi"))
    assert store.lookup(table, []).count() == 0


def test_metrics_count_what_the_sinks_write(spark, vectors, tmp_path):
    metrics = Metrics()
    with metrics.phase("templates"):
        store.write_templates(metrics.structures("templates", vectors), f"{tmp_path}/templates")
    lines = spark.createDataFrame([("a:1 2 3 4",), ("b:1 2 x 4",), ("c",), ("d:5 6 7 8;1 1 1 1",)], "value string")
    good, bad = parse_prints(lines)
    metrics.watch("rejects", bad).write.parquet(f"{tmp_path}/rejects")
    metrics.watch("prints", good, minutiae=F.sum("n")).write.parquet(f"{tmp_path}/prints")
    counts = metrics.counts()
    assert counts["templates"] == {"rows": vectors.count(), "fingerprints": vectors.count(),
                                   "structures": vectors.agg(F.sum("n_ls")).first()[0]}
    assert counts["rejects"] == {"rows": 2} and counts["prints"] == {"rows": 2, "minutiae": 3}
    assert metrics.seconds["templates"] > 0
    with pytest.raises(ValueError):
        metrics.watch("rejects", bad)


def test_metrics_of_rows_in_chunks(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(oversize, "MAX_ROW_MINUTIAE", 8)
    t = X.template_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000004")
    parts = P.enrol(t, X.ORDER, "jiang", limit=20).cache()
    metrics = Metrics()
    store.write_templates(metrics.structures("templates", parts), f"{tmp_path}/templates")
    assert metrics.counts()["templates"]["fingerprints"] == parts.select("fpid").distinct().count() < parts.count()


def test_text_forms_round_trip(spark, sf_dir, vectors):
    flat = jiang.flat_structures(vectors)
    back, bad = codec.parse_vectors(codec.print_vectors(flat))
    assert rows(back) == rows(flat.drop("n_ls")) and bad.count() == 0
    cylinders = flat_cylinders(P.enrol(X.probe_minutiae(spark, sf_dir), X.ORDER, "cylinder", "input"))
    back, bad = codec.parse_cylinders(codec.print_cylinders(cylinders))
    plain = ["fpid", "lsid", "x", "y", "th", "norm", F.hash("cm").alias("cm")]
    assert rows(back.select(plain)) == rows(cylinders.select(plain)) and bad.count() == 0


def test_a_line_is_split_once(spark):
    """A filter on parsed fields does not repeat the split of the line, nor what the line was printed from."""
    lines = spark.createDataFrame([("A;1",)], "value string").select(F.concat("value", F.lit(";x")).alias("value"))
    for parse, splits in ((codec.parse_vectors, 3), (codec.parse_minutia_lines, 2), (codec.parse_cylinders, 3)):
        for side in parse(lines):
            plan = side._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("split(") <= splits and plan.count("concat(") <= 1


def test_text_forms_reject_what_does_not_parse(spark):
    good = "f;3;3 1 2 -128 0;" + " ".join(["1.5 7 -8"] * 4)
    bad = [None, "", "f", good.replace("f;", ";", 1), good + " 1", good.replace("-128", "-129"), good.replace(";3;", ";x;"),
           good.replace("7", "7.5"), good.replace("1.5", "a"), good.replace("3 1 2", "3 1"), good + ";"]
    rows_, rejects = codec.parse_vectors(spark.createDataFrame([(v,) for v in [good, *bad]], "value string"))
    assert [tuple(r)[:8] for r in rows_.collect()] == [("f", 3, 1, 2, -128, 1.5, 7, -8)]
    assert sorted(map(str, (r[0] for r in rejects.collect()))) == sorted(map(str, bad))
    lines = spark.createDataFrame([("a;0 1 2 3 4",), ("a;0 1 2 3",), (";0 1 2 3 4",), ("a;0 1 2 300 4",), (None,)], "value string")
    minutiae, rejects = codec.parse_minutia_lines(lines)
    assert [tuple(r) for r in minutiae.collect()] == [("a", 0, 1, 2, 3, 4)] and rejects.count() == 4


@pytest.mark.parametrize("kind", ["jiang", "cylinder"])
def test_records_of_a_large_id_are_merged_as_rows(spark, kind, monkeypatch):
    """One id holds most records; its minutiae never meet in one array."""
    r = random.Random(6)

    def record(name, n):
        return name + ":" + ";".join(f"{r.randint(0, 200)} {r.randint(0, 200)} {r.randint(0, 179)} 50" for _ in range(n))

    lines = [record("hot", r.randint(1, 9)) for _ in range(12)] + [record(f"p{k % 4}", 9) for k in range(8)]
    lines += [lines[0]] * 2                                 # equal records stay records of their own
    prints = parse_prints(spark.createDataFrame([(v,) for v in lines], "value string").repartition(4))[0]
    want = P.build_local_structures(prints, kind)
    monkeypatch.setattr(oversize, "MAX_ROW_MINUTIAE", 8)
    got = P.build_local_structures(prints, kind, limit=30)
    assert got.filter("fpid = 'hot' and n_chunks > 1").count() > 1

    def flat(df):
        exact = ["fpid", "n_ls", "lsid", "x", "y", "th"]
        return rows(df.select("fpid", "n_ls", F.inline("ls")).select(exact))

    assert flat(got) == flat(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(minutiae") == 1         # of the others only


def test_a_line_of_minutiae_is_split_once(spark):
    """Filters on parsed minutiae repeat neither the split of the line nor what the line was printed from."""
    lines = spark.createDataFrame([("A:1 2 3",)], "value string").select(F.concat("value", F.lit(" 4")).alias("value"))
    for side in parse_prints(lines):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 3 and plan.count("concat(") <= 1
