"""Angle, number, name and text expressions on hand-written cases."""

import math

import pytest
from results import rows
from pyspark.sql import functions as F

from ridgemark.functions import angles as A
from ridgemark.functions import numeric as N
from ridgemark.functions.names import db_type, genuine
from ridgemark.sources.minutiae import (find_fingerprint, parse_minutiae, parse_prints, read_lines,
                                        read_xyt, union_prints)
from ridgemark.sources.scores import id_list, parse_scores


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_angle_round_trip(spark):
    got = spark.range(180).select("id", A.encode(F.col("id")).alias("th")).select(
        "id", "th", A.degrees(F.col("th")).alias("deg")).collect()
    fixed = {0: (-128, 0), 1: (-126, 2), 44: (-65, 88), 45: (-64, 90), 90: (0, 180), 179: (126, 357)}
    for r in got:
        exact = (r["id"] * 512 - 46080) / 360
        assert r["th"] == math.trunc(exact)
        assert abs(r["deg"] - 2 * r["id"]) <= 2
        if r["id"] in fixed:
            assert (r["th"], r["deg"]) == fixed[r["id"]]


def test_differences(spark):
    r = one(spark, A.diff256(F.lit(120), F.lit(-120)).alias("wrap"),
            A.folded_diff(F.lit(3.0), F.lit(-3.0)).alias("folded"),
            A.folded_diff(F.lit(-3.0), F.lit(3.0)).alias("folded_low"),
            A.wrapped_diff(F.lit(3.0), F.lit(-3.0)).alias("wrapped"))
    assert r["wrap"] == -16
    assert r["folded"] == pytest.approx(2 * math.pi - 6) and r["folded_low"] == pytest.approx(2 * math.pi - 6)
    assert r["wrapped"] == pytest.approx(6 - 2 * math.pi)


def test_np_table(spark):
    got = spark.range(1, 60).select("id", N.np_expr(F.col("id"), F.lit(100)).alias("np")).collect()
    assert all(r["np"] == (4 if r["id"] < 20 else 5) for r in got)
    wide = N.np_expr(F.lit(50), F.lit(40), lambda n: F.least(n, F.lit(12)))
    assert one(spark, wide.alias("np"))["np"] == 12


def test_direction_weights():
    w = N.direction_weights()
    assert len(w) == 256 and max(w) == w[128]
    assert all(w[128 + b] == pytest.approx(w[128 - b]) for b in range(1, 128))


def test_arrays(spark):
    v = F.array(*[F.lit(x) for x in (3, 1, 3, 2)])
    r = one(spark, N.top_n(v, 3).alias("top"), N.top_n_distinct(v, 3).alias("distinct"),
            N.sort_indexes(v).alias("order"), N.min_position(v).alias("min"), N.max_position(v).alias("max"),
            N.without_nulls(F.array(F.lit(1), F.lit(None))).alias("kept"))
    assert (r["top"], r["distinct"], r["order"]) == ([3, 3, 2], [3, 2, 1], [1, 3, 0, 2])
    assert (r["min"], r["max"], r["kept"]) == (1, 0, [1])


GENUINE = [
    ("/nist/f0001.xyt", "/nist/s0001.xyt", "nist", True),
    ("/db/Finger000010_1.xyt", "/db/Finger000010_2.xyt", "sfinge", True),
    ("/fvc/101_1.xyt", "/fvc/101_2.xyt", "fvc", True),
    ("/fvc/01_1.xyt", "/fvc/101_2.xyt", "fvc", True),
    ("/fvc/101_2.xyt", "/fvc/01_1.xyt", "fvc", False),
    ("/m/dp_0001_3_11.xyt", "/m/pb_0001_3_02.xyt", "mcyt", True),
    ("/001/L/001_L0_0.xyt", "/001/L/001_L0_3.xyt", "casiav5", True),
    ("/fp/FX3000_0012_01.xyt", "/fp/AES2501_0012_05.xyt", "fingerpass", True),
    ("/sp/00001ABCDRE001.xyt", "/sp/00001ABCEV1002.xyt", "spain", True),
]


def test_genuine_rules(spark):
    df = spark.createDataFrame(GENUINE, "f1 string, f2 string, kind string, same boolean")
    got = df.select("*", db_type(F.col("f1")).alias("k1"), genuine(F.col("f1"), F.col("f2")).alias("auto"),
                    genuine(F.col("f1"), F.col("f2"), F.col("kind")).alias("named")).collect()
    assert all(r["k1"] == r["kind"] and r["auto"] == r["same"] == r["named"] for r in got)
    mixed = one(spark, genuine(F.lit("/fvc/101_1.xyt"), F.lit("/nist/f0001.xyt")).alias("g"))
    assert mixed["g"] is False


def test_parse_lines(spark):
    lines = spark.createDataFrame([("A:10 20 30 40;11 21 31 41",), ("B:10 20 30 40;11 21 31;1 2 3 4",), ("C:",),
                                   ("D:x 1 1 1",), ("E:1 1 1 200",), ("F:1 1 1",), ("",)], "value string")
    flat, rejects = parse_minutiae(lines)
    assert rows(flat.select("fpid", "idx", "x", "y", "th", "q")) == sorted(
        (f, i, q, th, x, y) for f, i, x, y, th, q in
        [("A", 0, 10, 20, -85, 40), ("A", 1, 11, 21, -83, 41), ("B", 0, 10, 20, -85, 40)])
    assert {r[0] for r in rejects.collect()} == {"C:", "D:x 1 1 1", "E:1 1 1 200", "F:1 1 1", ""}


def test_files(spark, tmp_path):
    (tmp_path / "one.xyt").write_text("10 20 30 40\n11 21 31 41\n")
    (tmp_path / "two.xyt").write_text("1 2 3 4\n")
    prints = read_xyt(spark, str(tmp_path))
    assert {(r["fpid"], r["n"]) for r in prints.collect()} == {("one", 2), ("two", 1)}
    (tmp_path / "a.txt").write_text("A:1 2 3 4\n")
    (tmp_path / "b.txt").write_text("B:1 2 3 4\n")
    both = parse_prints(read_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]))[0]
    assert union_prints(both, prints).count() == 4
    assert find_fingerprint(both, "B").count() == 1


def test_score_lines(spark):
    mr = spark.createDataFrame([("0.5\tA_1.xyt;B_2.xyt",), ("oops",)], "value string")
    rdd = spark.createDataFrame([("(cylinder;A_1.xyt,(B_2.xyt,0.5))",), ("(A_1,(B_2,0.25))",), ("x",)], "value string")
    good, bad = parse_scores(mr, "mapreduce")
    assert rows(good) == [("B_2", 0.5, "A_1")] and bad.count() == 1
    good, bad = parse_scores(rdd, "rdd")
    assert rows(good) == [("B_2", 0.25, "A_1"), ("B_2", 0.5, "A_1")] and bad.count() == 1
    paths = spark.createDataFrame([("/a/F_1.xyt",), ("/b/F_1.xyt",), ("G_2",)], "value string")
    assert rows(id_list(paths)) == [("F_1",), ("G_2",)]


def test_rho_of_one_motion_is_high(spark):
    def m(x, y, th):
        return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(th).alias("th"))

    same = N.rho_expr(m(10, 10, 5), m(30, 25, 5), m(60, 80, 40), m(80, 95, 40))
    other = N.rho_expr(m(10, 10, 5), m(30, 25, 5), m(60, 80, 40), m(10, 95, -90))
    r = one(spark, same.alias("same"), other.alias("other"))
    assert r["same"] > 0.99 and r["other"] < 0.01
