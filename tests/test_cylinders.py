"""Cylinders of many prints at once, and what their matches keep, against dense arrays."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgemark.operators import arrow, oversize
from ridgemark.operators import cylinder as Y
from ridgemark.plans import enrol as P
from ridgemark.settings import CELL_RADIUS, GAUSS_RATE, GAUSS_SCALE, LEVEL_DIRECTIONS
from ridgemark.sources import fixture as X


def _prints(seed):
    r = np.random.default_rng(seed)
    for n, width, height in [(33, 240, 320), (28, 240, 320), (1, 9, 9), (5, 90, 90), (30, 1, 300), (12, 1, 1), (90, 60, 60), (200, 700, 700)]:
        yield r.integers(0, width, n), r.integers(0, height, n), r.integers(-128, 128, n)


def _dense(x, y, th):
    """Cells of one print: every minutia against every cell of every cylinder, every edge of the hull."""
    px, py = Y.cell_centres(x, y, th)
    valid = Y.near_hull(px, py, Y.hull_vertices(x, y))
    d2 = np.square(px[:, :, None] - x) + np.square(py[:, :, None] - y)
    d2[np.arange(len(x)), :, np.arange(len(x))] = np.inf
    near = np.where(d2 <= CELL_RADIUS ** 2, GAUSS_SCALE / np.exp(np.minimum(d2, 1e4) * GAUSS_RATE), 0)
    turn = Y.wrap(th[:, None] - th)[:, :, None] - np.array(LEVEL_DIRECTIONS)
    return Y.encode_cells(near @ Y._WEIGHTS[Y.wrap(turn) + 128], valid)


@pytest.mark.parametrize("pairs", [1, 1 << 15])
def test_prints_together_have_the_cells_of_each(pairs, monkeypatch):
    monkeypatch.setattr(Y, "_PRINT_PAIRS", pairs)
    prints = list(_prints(4))
    offsets = np.concatenate([[0], np.cumsum([len(p[0]) for p in prints])])
    x, y, th = (np.concatenate(v) for v in zip(*prints))
    found = [Y.cylinders(x[a:b], y[a:b], th[a:b], offsets[f:n + 1] - a)[0]
             for f, n in Y._print_blocks(offsets) for a, b in [(offsets[f], offsets[n])]]
    want = np.concatenate([_dense(*p) for p in prints])
    assert np.allclose(np.concatenate(found), want, rtol=0, atol=1e-6)


def test_digests_are_those_of_the_cells(spark, sf_dir, monkeypatch):
    flat = X.probe_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000005").cache()
    cells = Y.flat_cylinders(P.enrol(flat, X.ORDER, "cylinder", "input")).select("fpid", "lsid", "cm", "norm").collect()
    want = {(c.fpid, c.lsid): (sum(v >= 0 for v in c.cm) // 6, sum(v for v in c.cm if v > 0), c.norm) for c in cells}
    monkeypatch.setattr(oversize, "MAX_ROW_MINUTIAE", 8)
    for limit in (1024, 20):
        found = P.cylinder_digests(flat, X.ORDER, limit).collect()
        assert {(c.fpid, c.lsid) for c in found} == want.keys()
        assert all((c.valid_cells, c.total, c.norm) == pytest.approx(want[c.fpid, c.lsid], abs=1e-5) for c in found)


def test_directions_out_of_reach_are_left_out(spark, sf_dir, monkeypatch):
    """Windows of directions, sums by products and unneeded sums change no summary."""
    t = P.enrol(X.template_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000004"), X.ORDER, "cylinder").cache()
    i = P.enrol(X.probe_minutiae(spark, sf_dir).filter(F.col("fpid") < "Finger000000000006"), X.ORDER, "cylinder", "input").cache()

    class Probes:
        split = False

        def __init__(self):
            self.block = Y.prepared(i.toArrow().combine_chunks())

        def blocks(self):
            yield self.block

    batch = t.select("fpid", "n_chunks", "n_ls", "ls").toArrow().combine_chunks().to_batches()[0]

    def found(sums=True):
        table = pa.Table.from_batches(list(Y._summary_batches(Probes(), 5, True, sums)([batch])))
        return sorted(table.to_pylist(), key=lambda r: (r["t_fpid"], r["i_fpid"]))

    near = found()
    side = Y.Side(batch["ls"])
    assert len(side.windows()) == Y.TURN_RANGES and all(len(at) < len(side.row) for at, _ in side.windows())
    sums = ("matches", "sl_sum", "over_n", "over_sum")
    assert [{k: v for k, v in r.items() if k not in sums} for r in near] == [{k: v for k, v in r.items() if k not in sums} for r in found(False)]
    assert all(r[k] is None for r in found(False) for k in sums)
    monkeypatch.setattr(Y, "_WINDOW_LS", 0)
    assert found() == near
    monkeypatch.setattr(Y, "_ROW_LS", 1)
    assert found() == near


def test_batches_are_bounded(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    flat = X.probe_minutiae(spark, sf_dir)
    P.enrol(flat, X.ORDER, "cylinder")
    assert int(spark.conf.get(name)) == arrow.MAX_BATCH_ROWS
    spark.conf.set(name, before)
    batch = pa.record_batch({"ls": pa.array([[1] * n for n in (3, 0, 9, 1, 2, 0)])})
    cut = [b["ls"].to_pylist() for b in arrow.pieces([batch, batch.slice(2)], 4)]
    assert [[len(v) for v in c] for c in cut] == [[3, 0], [9], [1, 2, 0], [9], [1, 2, 0]]
