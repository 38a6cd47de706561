"""Neighbourhood vectors: features and the similarity join."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgemark.functions import angles as A
from ridgemark.functions.numeric import millionths
from ridgemark.operators.arrow import pieces, struct_fields, struct_lists
from ridgemark.operators.probes import ProbeSide
from ridgemark.settings import (ANGLE_WEIGHT, BOX_TH, BOX_X, BOX_Y, MAX_BROADCAST_LS, MAX_DIST,
                                MIN_DIST, NEIGHBOURS, SUM_BOUND)

K = range(1, NEIGHBOURS + 1)
ANGLES = [f"r{k}" for k in K] + [f"v{k}" for k in K]


_LS_FIELDS = (["lsid int", "x int", "y int", "th int"] + [f"d{k} double" for k in K]
              + [f"r{k} int" for k in K] + [f"v{k} int" for k in K])
SCHEMA = f"fpid string, n_ls bigint, ls array<struct<{', '.join(f.replace(' ', ':') for f in _LS_FIELDS)}>>"


def nearest(x: np.ndarray, y: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, neighbour, squared distance) of the nearest minutiae inside each print.

    Owner and neighbour are places in ``x``. Neighbours at one distance collapse
    to the last of them. Owners without four distinct distances are left out;
    the others have four rows each. Prints of similar size are padded into one block.
    """
    sizes, found, lo = np.diff(offsets), [], 0
    by_size = np.argsort(sizes, kind="stable")
    by_size = by_size[sizes[by_size] > 0]
    while lo < len(by_size):
        hi = lo + 1
        while hi < len(by_size) and (hi - lo + 1) * int(sizes[by_size[hi]]) ** 2 <= _NEAR_PAIRS:
            hi += 1
        rows, width = by_size[lo:hi], int(sizes[by_size[hi - 1]])
        lo = hi
        place = np.arange(width)
        used = place < sizes[rows][:, None]
        at = offsets[rows][:, None] + np.minimum(place, sizes[rows][:, None] - 1)
        bx, by = x[at], y[at]
        none = np.iinfo(np.int64).max // (2 * width)
        d2 = np.square(bx[:, :, None] - bx[:, None, :]) + np.square(by[:, :, None] - by[:, None, :])
        d2[~(used[:, :, None] & used[:, None, :])] = none
        d2[:, place, place] = none
        order = np.sort(d2 * width + place[::-1], axis=2)
        dist, near = order // width, width - 1 - order % width
        first = dist < none
        first[:, :, 1:] &= dist[:, :, 1:] != dist[:, :, :-1]
        rank = np.cumsum(first, axis=2)
        f, owner, k = np.nonzero(first & (rank <= NEIGHBOURS) & (rank[:, :, -1:] >= NEIGHBOURS))
        found.append((at[f, owner], at[f, near[f, owner, k]], dist[f, owner, k]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    owner, near, d2 = (np.concatenate(c) for c in zip(*found))
    back = np.argsort(owner, kind="stable")
    return owner[back], near[back], d2[back]


def neighbour_rows(prints: DataFrame) -> DataFrame:
    """Rows ``fpid, idx, k, neighbour, d2`` of the nearest minutiae."""
    def run(batches):
        for batch in pieces(batches, _ROW_LS, "minutiae"):
            offsets, m = struct_fields(batch["minutiae"], ("idx", "x", "y"))
            owner, near, d2 = nearest(m["x"].astype(np.int64), m["y"].astype(np.int64), offsets)
            prints_of = pa.array(np.searchsorted(offsets, owner, "right") - 1)
            yield pa.RecordBatch.from_arrays(
                [batch["fpid"].take(prints_of), pa.array(m["idx"][owner]),
                 pa.array(np.tile(np.arange(1, NEIGHBOURS + 1, dtype=np.int32), len(owner) // NEIGHBOURS)),
                 pa.array(m["idx"][near]), pa.array(d2)], names=["fpid", "idx", "k", "neighbour", "d2"])

    return prints.select("fpid", "minutiae").mapInArrow(
        run, "fpid string, idx int, k int, neighbour int, d2 bigint")


def vectors(m: dict[str, np.ndarray], owner, near, d2) -> dict[str, np.ndarray]:
    """Local-structure fields from neighbour rows, four in order per owner."""
    def wrap(v):
        return ((v + 128) % 256 - 128).astype(np.int32)

    own = owner[::NEIGHBOURS]
    bearing = np.arctan2((m["y"][owner] - m["y"][near]).astype(float),
                         (m["x"][owner] - m["x"][near]).astype(float))
    dist = np.sqrt(d2.astype(float)).reshape(-1, NEIGHBOURS)
    radial = wrap(np.trunc(bearing * 128 / math.pi).astype(np.int64) + m["th"][owner]).reshape(-1, NEIGHBOURS)
    turn = wrap(m["th"][near] - m["th"][owner]).reshape(-1, NEIGHBOURS)
    out = {"lsid": m["idx"][own], "x": m["x"][own], "y": m["y"][own], "th": m["th"][own]}
    out = {name: v.astype(np.int32) for name, v in out.items()}
    for prefix, values in (("d", dist), ("r", radial), ("v", turn)):
        out.update({f"{prefix}{k}": values[:, k - 1] for k in K})
    return out


def _built(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Structures of each print row: their number and their fields."""
    offsets, m = struct_fields(batch["minutiae"], ("idx", "x", "y", "th"))
    m = {name: v.astype(np.int64) for name, v in m.items()}
    owner, near, d2 = nearest(m["x"], m["y"], offsets)
    return np.diff(np.searchsorted(owner[::NEIGHBOURS], offsets)), vectors(m, owner, near, d2)


def _feature_batches(batches):
    for batch in pieces(batches, _ROW_LS, "minutiae"):
        lengths, fields = _built(batch)
        fields = {name: pa.array(v) for name, v in fields.items()}
        yield pa.RecordBatch.from_arrays(
            [batch["fpid"], pa.array(lengths, pa.int64()), struct_lists(lengths, fields)],
            names=["fpid", "n_ls", "ls"])


def jiang_features(prints: DataFrame) -> DataFrame:
    """Rows ``fpid, chunk, n_chunks, n_ls, ls ARRAY<STRUCT<lsid, x, y, th, d1-4, r1-4, v1-4>>``.

    A narrow map over print rows. A minutia with fewer than four distinct
    neighbour distances has no local structure; a fingerprint without any
    yields no row.
    """
    features = prints.select("fpid", "minutiae").mapInArrow(_feature_batches, SCHEMA)
    return keep_valid(features)


def keep_valid(features: DataFrame) -> DataFrame:
    """Drop structures with a distance out of range, and empty fingerprints."""
    def valid(ls: Column) -> Column:
        test = F.lit(True)
        for k in K:
            test = test & ls[f"d{k}"].between(MIN_DIST, MAX_DIST)
        return test

    kept = features.select("fpid", F.filter("ls", valid).alias("ls"))
    return (kept.select("fpid", F.size("ls").cast("bigint").alias("n_ls"), "ls").filter("n_ls > 0")
            .select("fpid", F.lit(0).alias("chunk"), F.lit(1).alias("n_chunks"), "n_ls", "ls"))


def flat_structures(features: DataFrame, prefix: str = "") -> DataFrame:
    """One local structure per row, columns named with ``prefix``."""
    flat = features.select("fpid", "n_ls", F.inline("ls"))
    names = {"n_ls": "n_" + prefix.rstrip("_")} if prefix else {}
    return flat.select([F.col(c).alias(names.get(c, prefix + c)) for c in flat.columns])


def similarity(a: str, b: str) -> tuple[Column, Column]:
    """(join condition, similarity in millionths) of the columns ``a*``, ``b*``."""
    t, i = (lambda n: F.col(a + n)), (lambda n: F.col(b + n))
    lengths = sum((F.abs(t(f"d{k}") - i(f"d{k}")) for k in K[1:]), F.abs(t("d1") - i("d1")))
    turns = sum((F.abs(A.diff256(t(n), i(n))) for n in ANGLES[1:]), F.abs(A.diff256(t("r1"), i("r1"))))
    total = lengths + turns * F.lit(ANGLE_WEIGHT)
    box = ((F.abs(t("x") - i("x")) < BOX_X) & (F.abs(t("y") - i("y")) < BOX_Y)
           & (F.abs(A.diff256(t("th"), i("th"))) < BOX_TH))
    # The bound on the sum says "at least half a millionth" once, so that no
    # later filter repeats the sum: the generated loop must stay small enough
    # for the JIT compiler.
    return (total < SUM_BOUND * (1 - 4.99e-7)) & box, millionths(1 - total / SUM_BOUND)


MATCH_SCHEMA = ("t_fpid string, n_t bigint, t_lsid int, t_x int, t_y int, t_th int, "
                "i_fpid string, n_i bigint, i_lsid int, i_x int, i_y int, i_th int, sl bigint")
_NUMBERS = ("lsid", "x", "y", "th") + tuple(f"d{k}" for k in K) + tuple(ANGLES)
_BLOCK_PAIRS = 1 << 20
_NEAR_PAIRS = 1 << 17           # pairs of minutiae whose distances are sorted at once, about a hundred bytes each
_ROW_LS = 1 << 14               # structures of the rows that a task holds as arrays at once


def _pairs(t: dict, i: dict, lo: int, hi: int):
    """Structures lo..hi of ``t`` matching any of ``i``: positions and millionths.

    Directions are signed bytes, whose subtraction wraps as the circle does.
    The summed angle differences alone leave few pairs for the exact test.
    """
    turns = np.zeros((hi - lo, len(i["x"])), dtype=np.uint16)
    for name in ANGLES:
        turns += np.abs(t[name][lo:hi, None] - i[name]).view(np.uint8)
    a, b = np.nonzero(turns <= int(SUM_BOUND / ANGLE_WEIGHT))
    turns, a = turns[a, b], a + lo
    box = _in_box(t, i, a, b)
    a, b, turns = a[box], b[box], turns[box]
    sl = _millionths(t, i, a, b, turns)
    keep = sl > 0
    return a[keep], b[keep], sl[keep]


def _millionths(t: dict, i: dict, a, b, turns) -> np.ndarray:
    total = np.abs(t["d1"][a] - i["d1"][b])
    for k in K[1:]:
        total += np.abs(t[f"d{k}"][a] - i[f"d{k}"][b])
    total += turns * ANGLE_WEIGHT
    sl = np.floor((1 - total / SUM_BOUND + 1e-9) * 1e6 + 0.5).astype(np.int64)
    return np.where(total < SUM_BOUND, sl, 0)


def _in_box(t: dict, i: dict, a, b) -> np.ndarray:
    return ((np.abs(t["x"][a] - i["x"][b]) < BOX_X) & (np.abs(t["y"][a] - i["y"][b]) < BOX_Y)
            & (np.abs(t["th8"][a] - i["th8"][b]).view(np.uint8) < BOX_TH))


def similarity_of(t: dict, i: dict, a, b) -> np.ndarray:
    """Similarities (millionths, 0 outside the box) of listed pairs."""
    turns = np.zeros(len(a), dtype=np.uint16)
    for name in ANGLES:
        turns += np.abs(t[name][a] - i[name][b]).view(np.uint8)
    return np.where(_in_box(t, i, a, b), _millionths(t, i, a, b, turns), 0)


def _columns(column) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    offsets, m = struct_fields(column, _NUMBERS)
    return np.repeat(np.arange(len(column)), np.diff(offsets)), _signed(m)


def _signed(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return m | {name: m[name].astype(np.int8) for name in ANGLES} | {"th8": m["th"].astype(np.int8)}


def _stored_rows(batches):
    """(template rows, owner per structure, fields) of rows with structures."""
    for batch in pieces(batches, _ROW_LS):
        yield batch, *_columns(batch["ls"])


def _print_rows(batches):
    """(template rows, owner per structure, fields) of print rows: valid structures are built where they are matched."""
    for batch in pieces(batches, _ROW_LS, "minutiae"):
        lengths, m = _built(batch)
        valid = np.all([(m[f"d{k}"] >= MIN_DIST) & (m[f"d{k}"] <= MAX_DIST) for k in K], axis=0)
        owner = np.repeat(np.arange(batch.num_rows), lengths)[valid]
        sizes = np.bincount(owner, minlength=batch.num_rows)
        rows = pa.RecordBatch.from_arrays([batch["fpid"], pa.array(sizes, pa.int64())], names=["fpid", "n_ls"])
        yield rows, owner, _signed({name: v[valid] for name, v in m.items()})


def _template_rows(templates: DataFrame):
    """The columns that a match reads, and the way from their batches to structures."""
    if "minutiae" in templates.columns:
        return templates.select("fpid", "minutiae"), _print_rows
    return templates.select("fpid", "n_ls", "ls"), _stored_rows


def _best_per_template(a, b, sl, owner, lsid) -> np.ndarray:
    """Positions of the best match of each (template structure, probe)."""
    order = np.lexsort((lsid[b], sl, owner[b], a))
    last = np.append((np.diff(a[order]) != 0) | (np.diff(owner[b[order]]) != 0), True)
    return order[last[:len(order)]]


def _match_batches(probes: ProbeSide, best: bool, rows_of):
    def run(batches):
        for batch, t_row, t in rows_of(batches):
            for i_fpid, i_n, i_row, i in probes.blocks():
                step = max(1, _BLOCK_PAIRS // max(1, len(i_row)))
                for lo in range(0, len(t_row), step):
                    a, b, sl = _pairs(t, i, lo, min(lo + step, len(t_row)))
                    if not len(a):
                        continue
                    if best:
                        keep = _best_per_template(a, b, sl, i_row, i["lsid"])
                        a, b, sl = a[keep], b[keep], sl[keep]
                    rows, probe_rows = pa.array(t_row[a]), pa.array(i_row[b])
                    yield pa.RecordBatch.from_arrays(
                        [batch["fpid"].take(rows), batch["n_ls"].take(rows)]
                        + [pa.array(t[n][a]) for n in ("lsid", "x", "y", "th")]
                        + [i_fpid.take(probe_rows), i_n.take(probe_rows)]
                        + [pa.array(i[n][b]) for n in ("lsid", "x", "y", "th")] + [pa.array(sl)],
                        names=[f.split()[0] for f in MATCH_SCHEMA.split(", ")])
    return run


def _row_blocks(starts: np.ndarray, goal: int):
    """(first, last) runs of template rows of about ``goal`` structures; a row is never cut."""
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + goal, "right")) - 1)
        yield first, last
        first = last


def local_totals(templates: DataFrame, probes: ProbeSide) -> DataFrame:
    """``t_fpid, n_t, i_fpid, total`` of whole templates and blocks of whole probes, without a shuffle.

    Templates are rows with structures, or print rows (``fpid, n, minutiae``)
    whose structures are built in the task that matches them and never leave it.
    """
    columns, rows_of = _template_rows(templates)

    def run(batches):
        for batch, t_row, t in rows_of(batches):
            starts = np.searchsorted(t_row, np.arange(batch.num_rows + 1))
            for block in probes.blocks():
                yield from totals(batch, t_row, t, starts, *block)

    def totals(batch, t_row, t, starts, i_fpid, _, i_row, i):
        step = max(1, _BLOCK_PAIRS // max(1, len(i_row)))
        for first, last in _row_blocks(starts, step):
            found = []
            for lo in range(starts[first], starts[last], step):
                a, b, sl = _pairs(t, i, lo, min(lo + step, starts[last]))
                keep = _best_per_template(a, b, sl, i_row, i["lsid"])
                found.append((a[keep], b[keep], sl[keep]))
            if not found:
                continue
            a, b, sl = (np.concatenate(v) for v in zip(*found))
            row = t_row[a]
            order = np.lexsort((sl, b, row))
            top = np.append((np.diff(row[order]) != 0) | (np.diff(b[order]) != 0), True)[:len(order)]
            row, b, sl = row[order][top], b[order][top], sl[order][top]
            pair, which = np.unique(row.astype(np.int64) * len(i_fpid) + i_row[b], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, which, sl)
            rows = pa.array(pair // len(i_fpid))
            yield pa.RecordBatch.from_arrays(
                [batch["fpid"].take(rows), batch["n_ls"].take(rows), i_fpid.take(pa.array(pair % len(i_fpid))),
                 pa.array(total)], names=["t_fpid", "n_t", "i_fpid", "total"])

    return columns.mapInArrow(run, "t_fpid string, n_t bigint, i_fpid string, total bigint")


def jiang_matches(templates: DataFrame, inputs: DataFrame, best: bool = False, bound: int | None = None) -> DataFrame:
    """Local matches of similarity above zero (``sl`` in millionths).

    ``best`` keeps one match per template structure and probe: the highest
    similarity, then the highest probe structure.

    A narrow map over the template rows, which walks the blocks of the probe
    set; only the best matches of a probe beyond the bound need an aggregate.
    """
    probes = ProbeSide(inputs, MAX_BROADCAST_LS["jiang"] if bound is None else bound, prepared)
    columns, rows_of = _template_rows(templates)
    found = columns.mapInArrow(_match_batches(probes, best, rows_of), MATCH_SCHEMA)
    return best_per_template(found) if best and probes.split else found


def prepared(table: pa.Table):
    """A block of probes as (ids, sizes, owner per structure, fields), by (id, structure).

    Chunks of one large probe come together again here.
    """
    ids, owners = np.unique(table["fpid"].to_numpy(), return_inverse=True)
    sizes = np.zeros(len(ids), dtype=np.int64)
    sizes[owners] = table["n_ls"].to_numpy()
    rows, fields = _columns(table["ls"].combine_chunks())
    order = np.lexsort((fields["lsid"], owners[rows]))
    return pa.array(ids, pa.string()), pa.array(sizes), owners[rows][order], {name: v[order] for name, v in fields.items()}


def best_per_template(matches: DataFrame) -> DataFrame:
    """The ``best`` matches of a joined set.

    Similarity and probe structure are packed into one number, which keeps
    the step a hash aggregate.
    """
    packed = F.col("sl") * F.lit(1 << 32) + F.col("i_lsid")
    return (matches.groupBy("t_fpid", "n_t", "i_fpid", "t_lsid").agg(F.max(packed).alias("best"))
            .select("t_fpid", "n_t", "i_fpid", "t_lsid", F.shiftright("best", 32).alias("sl"),
                    F.col("best").bitwiseAND(F.lit((1 << 32) - 1)).alias("i_lsid")))
