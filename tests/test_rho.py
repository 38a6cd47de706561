"""Summed compatibilities in blocks of matches."""

import numpy as np
import pyarrow as pa
import pytest

from ridgemark.operators import relax

NAMES = ("sl", "t_x", "t_y", "t_th", "i_x", "i_y", "i_th")


def _pairs(spark, sizes, seed=3):
    r = np.random.default_rng(seed)
    tables, rows = [], []
    for n in sizes:
        m = {k: r.integers(0, 60, n) for k in NAMES if not k.endswith("th")}
        m.update({k: r.integers(-20, 20, n) for k in ("t_th", "i_th")})
        tables.append(m)
    for k, m in enumerate(tables):
        rows.append((f"t{k}", "i", max(len(m["sl"]) - 1, 0), [tuple(int(m[n][j]) for n in NAMES) for j in range(len(m["sl"]))]))
    kind = ", ".join(f"{n}:int" for n in NAMES)
    return tables, spark.createDataFrame(rows, f"t_fpid string, i_fpid string, nr int, top array<struct<{kind}>>").repartition(3)


def test_blocks_add_up(spark):
    sizes = [0, 1, 2, 3, 7, 30, 61]
    tables, pairs = _pairs(spark, sizes)
    want = {}
    for k, m in enumerate(tables):
        nr = max(sizes[k] - 1, 0)
        if nr > 1:
            rho = relax.compatibility({n: v[None, :nr] for n, v in m.items()})[0]
            want[f"t{k}"] = rho.sum() - np.trace(rho)
    for block, largest in ((5, None), (512, None), (512, 60), (60, 60), (1, None)):
        got = {r["t_fpid"]: r["rho_sum"] for r in relax.rho_sums(pairs, largest, block).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=2e-3)


def test_a_large_pair_spreads_over_tasks(spark):
    """Twenty thousand matches: 40 blocks meet in 820 rows, and no row holds more than two blocks."""
    from pyspark.sql import functions as F
    kind = ", ".join(f"{n}:int" for n in NAMES)
    one = ", ".join(f"'{n}', cast(k * {j + 3} % 200 as int)" for j, n in enumerate(NAMES))
    pairs = spark.sql(f"select 't' as t_fpid, 'i' as i_fpid, 20000 as nr, transform(sequence(1, 20000), k -> "
                      f"cast(named_struct({one}) as struct<{kind}>)) as top")
    seen = spark.sparkContext.accumulator(0)
    held = relax._rho_batches

    def counted(batches):
        sizes = []
        for batch in batches:
            sizes += batch["m"].value_lengths().to_pylist()
        if sizes:
            seen.add(1)
            yield pa.RecordBatch.from_arrays([pa.array(["t"] * len(sizes)), pa.array(["i"] * len(sizes)),
                                              pa.array([20000] * len(sizes), pa.int32()), pa.array(np.array(sizes, float))],
                                             ["t_fpid", "i_fpid", "nr", "s"])

    relax._rho_batches = counted
    try:
        total = relax.rho_sums(pairs).agg(F.sum("rho_sum")).first()[0]
    finally:
        relax._rho_batches = held
    assert total == 20000 * 40 and seen.value > 4
