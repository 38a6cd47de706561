"""Relaxation of the retained matches of each pair (an Arrow map over pairs)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.functions.numeric import rounded
from ridgemark.operators.arrow import struct_fields
from ridgemark.operators.cylinder import radians_of
from ridgemark.settings import NP_MIN, NP_MU, NP_TAU, RELAX_ROUNDS, RELAX_WEIGHT, RHO_ANGLE, RHO_DIST

_FIELDS = ("sl", "t_x", "t_y", "t_th", "i_x", "i_y", "i_th")
_BLOCK_VALUES = 1 << 20
_TOGETHER_VALUES = 1 << 16      # of pairs of fingerprints that are relaxed together
SCORES_SCHEMA = "t_fpid string, i_fpid string, score double"
SUMS_SCHEMA = "t_fpid string, i_fpid string, nr int, s double"
RHO_BLOCK = 512                 # matches; two blocks fill one square of _BLOCK_VALUES


def _turn(d: np.ndarray) -> np.ndarray:
    d = np.where(d < -np.pi, d + 2 * np.pi, d)
    return np.where(d >= np.pi, d - 2 * np.pi, d)


def _sigmoid(v, mu, tau):
    return 1 / (1 + np.exp(tau * (mu - v)))


# Beyond these differences of distance and of angle a factor of ρ is below 1e-17, less than double
# precision can tell beside the diagonal of a sum; ρ is 0 there.
_FAR = RHO_DIST[0] - np.log(1e17) / RHO_DIST[1]
_WIDE = RHO_ANGLE[0] - np.log(1e17) / RHO_ANGLE[1]


def _between(d: np.ndarray) -> np.ndarray:
    """Absolute difference of two turns, from any difference of theirs in radians."""
    return np.abs(d - 2 * np.pi * np.rint(d / (2 * np.pi)))


def _lengths(ends, first, second) -> np.ndarray:
    """Absolute differences of the distances of two matches on either side."""
    apart = []
    for x, y in ends:
        dx, dy = x[first] - x[second], y[first] - y[second]
        dx *= dx
        dy *= dy
        dx += dy
        apart.append(np.sqrt(dx, out=dx))
    return np.abs(apart[0] - apart[1], out=apart[0])


def _close(m, rows: slice, largest: np.ndarray | None):
    """(pair, match, other match, difference of distances) where distances agree; of all matches, in one order."""
    pairs, width = m["t_x"].shape
    lo, hi, _ = rows.indices(width)
    ends = [[m[f"{side}_{c}"].astype(float).T.copy() for c in "xy"] for side in "ti"]
    if (lo, hi) == (0, width):
        # A pair of fingerprints to a column, so that even few matches make long rows.
        first, second = np.triu_indices(width)
        length = _lengths(ends, first, second)
        close = length < _FAR
        if largest is not None:
            close &= second[:, None] < largest
        at = np.flatnonzero(close)
        line, p = np.divmod(at, pairs) if pairs > 1 else (at, np.zeros_like(at))
        return p, first[line], second[line], length.ravel()[at]
    found = []
    for p in range(pairs):
        own = [[v[:, p] for v in side] for side in ends]
        length = _lengths(own, np.arange(lo, hi)[:, None], slice(None))
        at = np.flatnonzero(length < _FAR)
        j, k = np.divmod(at, width)
        found.append((np.full(len(at), p), lo + j, k, length.ravel()[at]))
    return tuple(np.concatenate(v) for v in zip(*found))


def _related(m: dict[str, np.ndarray], rows: slice = slice(None), largest: np.ndarray | None = None):
    """(pair, match, other match, ρ) where ρ is not 0; only the first ``largest`` matches of a pair, if given.

    Distances are compared first, then turns and directions of what is left. Only the
    direction depends on the order of two matches: it is opposite on either side, which
    changes nothing but where one side has both at one place. So all are taken once.
    """
    width = m["t_x"].shape[1]
    whole = rows.indices(width)[:2] == (0, width)
    p, j, k, length = _close(m, rows, largest)
    turned = (radians_of(m["t_th"]) - radians_of(m["i_th"])).ravel()
    own, other = p * width + j, p * width + k
    turn = _between(turned[own] - turned[other])
    near = np.flatnonzero(turn < _WIDE)
    p, own, other = p[near], own[near], other[near]
    e = (1 + np.exp(RHO_DIST[1] * (RHO_DIST[0] - length[near]))) * (1 + np.exp(RHO_ANGLE[1] * (RHO_ANGLE[0] - turn[near])))
    first, second = (own, other) if whole else (np.minimum(own, other), np.maximum(own, other))
    ways, same = [], []
    for s in "ti":
        x, y = m[f"{s}_x"].ravel(), m[f"{s}_y"].ravel()
        dy, dx = (y[first] - y[second]).astype(float), (x[second] - x[first]).astype(float)
        ways.append(np.arctan2(dy, dx))
        same.append((dx == 0) & (dy == 0))
    way, back = ways[0] - ways[1], np.pi * (same[0] != same[1])
    if whole:
        both = np.flatnonzero(own != other)
        way = np.append(turned[own] - way, turned[other[both]] - way[both] + back[both])
        p, e = np.append(p, p[both]), np.append(e, e[both])
        own, other = np.append(own, other[both]), np.append(other, own[both])
    else:
        way = turned[own] - way + back * (own > other)
    way = _between(way)
    near = np.flatnonzero(way < _WIDE)
    rho = 1 / (e[near] * (1 + np.exp(RHO_ANGLE[1] * (RHO_ANGLE[0] - way[near]))))
    p = p[near]
    return p, own[near] - p * width, other[near] - p * width, rho


def compatibility(m: dict[str, np.ndarray], rows: slice = slice(None)) -> np.ndarray:
    """ρ of the matches of ``rows`` with all matches: do both sides relate the same way?

    Arrays are (fingerprint pairs, matches).
    """
    p, j, k, rho = _related(m, rows)
    pairs, width = m["t_x"].shape
    first, last, _ = rows.indices(width)
    out = np.zeros((pairs, max(0, last - first), width))
    out[p, j - first, k] = rho
    return out


def relax(m: dict[str, np.ndarray], nr: np.ndarray, n_p: np.ndarray) -> np.ndarray:
    """Score of each pair from its first ``nr`` matches (padded to one width)."""
    width = m["sl"].shape[1]
    used = np.arange(width) < nr[:, None]
    p, j, k, related = _related(m, largest=nr)
    rho = np.zeros((len(nr), width, width))
    rho[p, j, k] = np.where(j == k, 0, related)
    start = np.where(used, m["sl"] / 1e6, 0.0)
    value = start
    weight = ((1 - RELAX_WEIGHT) / np.maximum(nr - 1, 1))[:, None]
    for _ in range(RELAX_ROUNDS):
        value = RELAX_WEIGHT * value + weight * np.einsum("pjk,pk->pj", rho, value)
    value = np.where(nr[:, None] > 1, value, start)
    efficiency = np.where(used, value / np.where(used, start, 1), -1)
    # Ascending and stable, read from the end: of equal values the later first.
    order = np.argsort(efficiency, axis=1, kind="stable")[:, ::-1]
    best = np.take_along_axis(value, order, axis=1)
    n_p = np.minimum(n_p, nr)
    return np.where(np.arange(width) < n_p[:, None], best, 0).sum(axis=1) / n_p


def _relax_rows(m: dict[str, np.ndarray], nr: int, n_p: int) -> float:
    """``relax`` of one pair with many matches: ρ is made anew in blocks of rows, and never held whole."""
    own = {n: v[None, :nr] for n, v in m.items()}
    start = m["sl"][:nr] / 1e6
    value, step = start, max(1, _BLOCK_VALUES // nr)
    for _ in range(RELAX_ROUNDS):
        sums = np.empty(nr)
        for lo in range(0, nr, step):
            rho = compatibility(own, slice(lo, lo + step))[0]
            rho[np.arange(len(rho)), lo + np.arange(len(rho))] = 0
            sums[lo:lo + step] = rho @ value
        value = RELAX_WEIGHT * value + (1 - RELAX_WEIGHT) / (nr - 1) * sums
    order = np.argsort(value / start, kind="stable")[::-1][:min(n_p, nr)]
    return float(value[order].sum() / len(order))


def _together(sizes: np.ndarray):
    """Rows to take as one array: of similar width, so that padding stays small, and with bounded squares."""
    order, lo = np.argsort(sizes, kind="stable"), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * int(sizes[order[hi]]) ** 2 <= _TOGETHER_VALUES:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _most(n_i, matched, kept):
    return np.minimum(np.minimum(n_i, matched), kept)


def half_retained(n_i, matched, kept):
    """Matches that are relaxed: half as many as the smaller side has."""
    return _most(n_i, matched, 2 * kept) // 2


def all_retained(n_i, matched, kept):
    """Matches that are relaxed: as many as the smaller side has."""
    return _most(n_i, matched, kept)


def _retained(batch, retained):
    """(matches to relax of each pair, offsets and fields of its matches)."""
    offsets, m = struct_fields(batch["top"], _FIELDS)
    nr = retained(batch["n_i"].to_numpy(), batch["matched"].to_numpy(), np.diff(offsets))
    return nr, offsets, m


def _averaged(n_i, matched) -> np.ndarray:
    """``np_expr`` of whole arrays."""
    return NP_MIN + np.floor(_sigmoid(np.minimum(n_i, matched).astype(float), NP_MU, NP_TAU) + 0.5).astype(np.int64)


def relaxed(retained):
    """Map of summaries to unrounded scores; ``retained`` gives the matches that are relaxed, 0 gives no row."""
    def run(batches):
        for batch in batches:
            nr, offsets, m = _retained(batch, retained)
            n_p = _averaged(batch["n_i"].to_numpy(), batch["matched"].to_numpy())
            scores, some = np.empty(batch.num_rows), np.flatnonzero(nr > 0)
            for rows in _together(nr[some]):
                rows = some[rows]
                width = int(nr[rows].max())
                if width ** 2 > _BLOCK_VALUES:
                    for r in rows:
                        scores[r] = _relax_rows({n: v[offsets[r]:offsets[r + 1]] for n, v in m.items()}, int(nr[r]), int(n_p[r]))
                    continue
                at = offsets[rows][:, None] + np.minimum(np.arange(width), nr[rows][:, None] - 1)
                scores[rows] = relax({n: v[at] for n, v in m.items()}, nr[rows], n_p[rows])
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch["t_fpid"].take(at), batch["i_fpid"].take(at), pa.array(scores[some])],
                                             names=["t_fpid", "i_fpid", "score"])
    return run


def summed(retained):
    """Map of summaries to unrounded sums of ρ over the ordered pairs of different retained matches."""
    def run(batches):
        for batch in batches:
            nr, offsets, m = _retained(batch, retained)
            sums, some = np.zeros(batch.num_rows), np.flatnonzero(nr > 1)
            for rows in _together(nr[some]):
                rows = some[rows]
                at = offsets[rows][:, None] + np.minimum(np.arange(int(nr[rows].max())), nr[rows][:, None] - 1)
                p, j, k, rho = _related({n: v[at] for n, v in m.items()}, largest=nr[rows])
                sums[rows] = np.bincount(p, np.where(j == k, 0, rho), len(rows))
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch["t_fpid"].take(at), batch["i_fpid"].take(at),
                                              pa.array(nr[some].astype(np.int32)), pa.array(sums[some])],
                                             names=["t_fpid", "i_fpid", "nr", "s"])
    return run


def _rho_batches(batches):
    """Summed ρ of rows ``m`` (matches), ``split``: of all ordered pairs of different matches or, with a split, of those across it."""
    for batch in batches:
        offsets, m = struct_fields(batch["m"], _FIELDS)
        sizes, split, sums = np.diff(offsets), batch["split"].to_numpy(), np.zeros(batch.num_rows)
        for rows in _together(sizes):
            at = offsets[rows][:, None] + np.minimum(np.arange(int(sizes[rows].max())), sizes[rows][:, None] - 1)
            p, j, k, rho = _related({n: v[at] for n, v in m.items()}, largest=sizes[rows])
            cut = split[rows][p]
            sums[rows] = np.bincount(p, np.where(np.where(cut > 0, (j >= cut) != (k >= cut), j != k), rho, 0), len(rows))
        yield pa.RecordBatch.from_arrays([batch["t_fpid"], batch["i_fpid"], batch["nr"], pa.array(sums)],
                                         names=["t_fpid", "i_fpid", "nr", "s"])


def rho_sums(pairs: DataFrame, largest: int | None = None, block: int = RHO_BLOCK) -> DataFrame:
    """``t_fpid, i_fpid, nr, rho_sum``: summed ρ over the ordered pairs of different retained matches.

    The matches of a pair go in blocks: each block meets itself and every later
    one, and the partial sums are added. ``largest`` is a bound on ``nr``, if one
    is known; beyond one block the blocks of a pair spread over tasks.
    """
    key = ["t_fpid", "i_fpid", "nr"]
    blocks = F.ceil(F.col("nr") / block).cast("int")
    used = pairs.filter("nr > 1").select(*key, F.slice("top", 1, F.col("nr")).alias("m"))
    first = used.select(*key, "m", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("p"))
    both = first.select(*key, "m", "p", F.explode(F.sequence("p", blocks - 1)).alias("q"))
    a, b = (F.slice("m", F.col(c) * block + 1, F.lit(block)) for c in "pq")
    parts = both.select(*key, "p", "q", F.when(F.col("p") == F.col("q"), a).otherwise(F.concat(a, b)).alias("m"),
                        F.when(F.col("p") == F.col("q"), 0).otherwise(F.size(a)).alias("split"))
    one = largest is not None and largest <= block
    parts = parts if one else parts.repartition("t_fpid", "i_fpid", "p", "q")
    sums = parts.select(*key, "m", "split").mapInArrow(_rho_batches, SUMS_SCHEMA)
    sums = sums if one else sums.groupBy(*key).agg(F.sum("s").alias("s"))
    return sums.select(*key, rounded(F.col("s"), 3).alias("rho_sum"))
