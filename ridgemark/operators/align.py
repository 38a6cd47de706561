"""Global alignment of neighbourhood vectors.

The five best local matches of a pair are seeds. Each seed aligns both
fingerprints; aligned minutiae that fall together are matched one to one,
best first, and the best seed gives the score.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgemark.functions import angles as A
from ridgemark.functions.numeric import rounded
from ridgemark.operators.arrow import pieces
from ridgemark.operators.jiang import (_BLOCK_PAIRS, _ROW_LS, _columns, _pairs, flat_structures, jiang_matches,
                                       prepared, similarity, similarity_of)
from ridgemark.operators.probes import ProbeSide, cut, probe_shape
from ridgemark.settings import ALIGN_ANGLE, ALIGN_DIST, DEG_TO_RAD, MAX_BROADCAST_LS, SEEDS

PAIR = ("t_fpid", "i_fpid")
HEAVY_SEED = 4096               # templates that align on one probe seed; more are dealt over salts
_SCHEMA = "t_fpid string, i_fpid string, total bigint, size bigint"
_BOX_SCHEMA = "t_fpid string, i_fpid string, n_t bigint, n_i bigint, rank int, t_lsid int, i_lsid int, weight bigint"


def _folded(d: np.ndarray) -> np.ndarray:
    return np.where(d > np.pi, 2 * np.pi - d, np.where(d <= -np.pi, 2 * np.pi + d, d))


def _turned(th) -> np.ndarray:
    return (180 - (th + 128) * 360 // 256) * DEG_TO_RAD


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, ``counts`` of each."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def aligned(m: dict, first: np.ndarray, counts: np.ndarray, ref: np.ndarray):
    """(group, place, distance, bearing, direction) of the minutiae of every group from its minutia ``ref``."""
    group, at = np.repeat(np.arange(len(first)), counts), spread(first, counts)
    seed = ref[group]
    dx, dy = m["x"][at] - m["x"][seed], m["y"][at] - m["y"][seed]
    own = _turned(m["th"][seed])
    return (group, at, np.sqrt((dx * dx + dy * dy).astype(float)),
            _folded(np.arctan2(dy.astype(float), dx.astype(float)) - own), _folded(_turned(m["th"][at]) - own))


def one_to_one(group: np.ndarray, a: np.ndarray, b: np.ndarray, priority: tuple, weight: np.ndarray, groups: int) -> np.ndarray:
    """Summed weight of the greedy one-to-one matching of each group.

    ``a`` and ``b`` are ends, different in different groups. Greedy takes the
    candidate of highest priority and drops those that share an end. The same
    ones are found in rounds over all groups: a candidate that is the best of
    both its ends is taken.
    """
    order = np.lexsort((*priority, weight))
    group, a, b, weight = group[order], a[order], b[order], weight[order]
    total = np.zeros(groups, np.int64)
    best = [np.zeros(int(e.max(initial=-1)) + 1, np.int64) for e in (a, b)]
    used = [np.zeros(len(x), bool) for x in best]
    while len(a):
        rank = np.arange(len(a))
        best[0][a], best[1][b] = rank, rank                # of a repeated end the last, which is the highest, stays
        taken = (best[0][a] == rank) & (best[1][b] == rank)
        np.add.at(total, group[taken], weight[taken])
        used[0][a[taken]] = used[1][b[taken]] = True
        left = ~(used[0][a] | used[1][b])
        group, a, b, weight = group[left], a[left], b[left], weight[left]
    return total


def seed_candidates(t: dict, i: dict, t_first, t_n, i_first, i_n, seed_t, seed_i) -> tuple[np.ndarray, ...]:
    """(seed, its minutia of either side, their places in ``t`` and ``i``, weight) of minutiae that fall together once both fingerprints are aligned."""
    tg, ta, *tf = aligned(t, t_first, t_n, seed_t)
    ig, ia, *jf = aligned(i, i_first, i_n, seed_i)
    # Group and distance in one number, so that one sorted search finds the distances near enough in all groups.
    width = max(tf[0].max(initial=0), jf[0].max(initial=0)) + 4 * ALIGN_DIST
    key = ig * width + jf[0]
    order = np.argsort(key, kind="stable")
    low = np.searchsorted(key[order], tg * width + tf[0] - ALIGN_DIST - 1e-3)
    n = np.searchsorted(key[order], tg * width + tf[0] + ALIGN_DIST + 1e-3) - low
    a = np.repeat(np.arange(len(tg)), n)
    b = order[spread(low, n)]
    for limit, own, other in zip((ALIGN_DIST, ALIGN_ANGLE, ALIGN_ANGLE), tf, jf):
        near = np.abs(own[a] - other[b]) < limit
        a, b = a[near], b[near]
    weight = 1_000_000 + similarity_of(t, i, ta[a], ia[b])
    return tg[a], a, b, ta[a], ia[b], weight


def seed_totals(t: dict, i: dict, t_first, t_n, i_first, i_n, seed_t, seed_i) -> np.ndarray:
    """Total of each seed: the candidates matched one to one."""
    seed, a, b, at, other, weight = seed_candidates(t, i, t_first, t_n, i_first, i_n, seed_t, seed_i)
    return one_to_one(seed, a, b, (i["lsid"][other], t["lsid"][at]), weight, len(t_first))


def _seed_blocks(t_starts, i_starts, row, probe, a, b):
    """Seeds (template row, probe, their structures) in blocks of bounded candidates: (first seed, arguments of the two functions above)."""
    t_n, i_n = np.diff(t_starts), np.diff(i_starts)
    upto = np.cumsum(t_n[row] * i_n[probe])
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 4 * _BLOCK_PAIRS, "right")))
        r, p = row[lo:hi], probe[lo:hi]
        yield lo, (t_starts[r], t_n[r], i_starts[p], i_n[p], a[lo:hi], b[lo:hi])
        lo = hi


def _best_seeds(t, i, *seeds) -> np.ndarray:
    """Total of every seed (template row, probe, their structures)."""
    return np.concatenate([seed_totals(t, i, *block) for _, block in _seed_blocks(*seeds)])


def _seeds(t_row, t, i_row, i, probes: int):
    """(structures of either side, pair, rank from 1) of the best local matches of each pair, in order of pairs."""
    step = max(1, _BLOCK_PAIRS // max(1, len(i_row)))
    found = [_pairs(t, i, lo, min(lo + step, len(t_row))) for lo in range(0, len(t_row), step)]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    a, b, sl = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((-i["lsid"][b], -t["lsid"][a], -sl, i_row[b], t_row[a]))
    a, b = a[order], b[order]
    pair = t_row[a].astype(np.int64) * probes + i_row[b]
    cuts = np.nonzero(np.diff(pair, prepend=-1))[0]
    rank = 1 + np.arange(len(pair)) - np.repeat(cuts, np.diff(np.append(cuts, len(pair))))
    seed = rank <= SEEDS
    return a[seed], b[seed], pair[seed], rank[seed]


def _batches(probes: ProbeSide):
    def run(batches):
        for batch in pieces(batches, _ROW_LS):
            t_row, t = _columns(batch["ls"])
            t_starts = np.searchsorted(t_row, np.arange(batch.num_rows + 1))
            for block in probes.blocks():
                yield from scored(batch, t_row, t, t_starts, *block)

    def scored(batch, t_row, t, t_starts, i_fpid, i_n, i_row, i):
        i_starts = np.searchsorted(i_row, np.arange(len(i_fpid) + 1))
        a, b, pair, _ = _seeds(t_row, t, i_row, i, len(i_fpid))
        if not len(a):
            return
        totals = _best_seeds(t, i, t_starts, i_starts, t_row[a], i_row[b], a, b)
        cuts = np.nonzero(np.diff(pair, prepend=-1))[0]
        rows, probe = pa.array(pair[cuts] // len(i_fpid)), pa.array(pair[cuts] % len(i_fpid))
        larger = np.maximum(batch["n_ls"].take(rows).to_numpy(), i_n.take(probe).to_numpy())
        yield pa.RecordBatch.from_arrays(
            [batch["fpid"].take(rows), i_fpid.take(probe), pa.array(np.maximum.reduceat(totals, cuts)), pa.array(larger)],
            names=["t_fpid", "i_fpid", "total", "size"])
    return run


def _box_batches(probes: ProbeSide):
    def placed(batches):
        for batch in pieces(batches, _ROW_LS):
            t_row, t = _columns(batch["ls"])
            t_starts = np.searchsorted(t_row, np.arange(batch.num_rows + 1))
            for block in probes.blocks():
                yield from boxes(batch, t_row, t, t_starts, *block)

    def boxes(batch, t_row, t, t_starts, i_fpid, i_n, i_row, i):
        i_starts = np.searchsorted(i_row, np.arange(len(i_fpid) + 1))
        a, b, _, rank = _seeds(t_row, t, i_row, i, len(i_fpid))
        for lo, block in _seed_blocks(t_starts, i_starts, t_row[a], i_row[b], a, b):
            seed, _, _, at, other, weight = seed_candidates(t, i, *block)
            rows, probe = pa.array(t_row[at]), pa.array(i_row[other])
            yield pa.RecordBatch.from_arrays(
                [batch["fpid"].take(rows), i_fpid.take(probe), batch["n_ls"].take(rows), i_n.take(probe),
                 pa.array(rank[lo + seed].astype(np.int32)), pa.array(t["lsid"][at]), pa.array(i["lsid"][other]), pa.array(weight)],
                names=[f.split()[0] for f in _BOX_SCHEMA.split(", ")])
    return placed


def box_matches(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """Aligned pairs ``t_lsid, i_lsid, weight`` of every seed (``rank``) of a pair.

    A narrow map over whole fingerprints, so that nothing but results leaves a task;
    templates stored in several chunks, and sets with a probe beyond the bound, are joined.
    """
    shape = probe_shape(inputs)
    if shape[1] > MAX_BROADCAST_LS["jiang"]:
        return joined_boxes(templates, inputs)
    probes = ProbeSide(inputs, MAX_BROADCAST_LS["jiang"], prepared, shape)
    chunked = templates.filter("n_chunks > 1")
    some = bool(chunked.limit(1).count())
    whole = templates.filter("n_chunks = 1") if some else templates
    found = whole.select("fpid", "n_ls", "ls").mapInArrow(_box_batches(probes), _BOX_SCHEMA)
    return found.unionByName(joined_boxes(chunked, inputs)) if some else found


def alignment_scores(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """Score rows of all pairs with a seed.

    A narrow map over whole fingerprints and bounded blocks of probes; templates
    stored in several chunks, and sets with a probe beyond the bound, take the
    joins below.
    """
    shape = probe_shape(inputs)
    if shape[1] > MAX_BROADCAST_LS["jiang"]:
        totals = assignment_totals(joined_boxes(templates, inputs))
    else:
        probes = ProbeSide(inputs, MAX_BROADCAST_LS["jiang"], prepared, shape)
        chunked = templates.filter("n_chunks > 1")
        some = bool(chunked.limit(1).count())
        whole = templates.filter("n_chunks = 1") if some else templates
        totals = whole.select("fpid", "n_ls", "ls").mapInArrow(_batches(probes), _SCHEMA)
        if some:
            totals = totals.unionByName(assignment_totals(joined_boxes(chunked, inputs)))
    return totals.select(*PAIR, rounded(F.col("total") / (F.col("size") * F.lit(2e6))).alias("score"))


def top_matches(matches: DataFrame, k: int) -> DataFrame:
    """The k best local matches of each pair, by (sl, template id, probe id).

    The rank filter prunes before the shuffle.
    """
    order = Window.partitionBy(*PAIR).orderBy(F.desc("sl"), F.desc("t_lsid"), F.desc("i_lsid"))
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _aligned(df: DataFrame, prefix: str) -> DataFrame:
    """Add distance, bearing and direction of structure ``prefix*`` from its seed ``s_*``."""
    dx, dy = F.col(prefix + "x") - F.col("s_x"), F.col(prefix + "y") - F.col("s_y")
    ref = A.complement_radians(F.col("s_th"))
    return (df.withColumn(prefix + "far", F.sqrt((dx * dx + dy * dy).cast("double")))
            .withColumn(prefix + "bearing", A.folded_diff(F.atan2(dy.cast("double"), dx.cast("double")), ref))
            .withColumn(prefix + "turn", A.folded_diff(A.complement_radians(F.col(prefix + "th")), ref))
            .drop("s_x", "s_y", "s_th"))


def joined_boxes(templates: DataFrame, inputs: DataFrame) -> DataFrame:
    """``box_matches`` of fingerprints of any size.

    Minutiae within the box lie in the same or adjacent cells of distance,
    bearing and turn around their seeds, so this is an equality join per probe
    seed and cell. Seeds are found once and cut off; a seed that many templates
    share is salted by template.
    """
    seeds = cut(top_matches(jiang_matches(templates, inputs), SEEDS))
    own = ["i_fpid", "i_lsid"]
    heavy = seeds.groupBy(*own).agg(F.ceil(F.count("*") / HEAVY_SEED).cast("int").alias("salts")).filter("salts > 1")
    seeds = seeds.join(heavy, own, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    seeds = seeds.withColumn("salt", F.pmod(F.xxhash64("t_fpid"), F.col("salts")).cast("int"))
    key = [*PAIR, "n_t", "n_i", "rank", F.col("i_lsid").alias("seed"), "salt"]
    t_side = _aligned(
        seeds.select(*key, *[F.col(f"t_{n}").alias(f"s_{n}") for n in ("x", "y", "th")])
        .join(flat_structures(templates, "t_").drop("n_t"), "t_fpid"), "t_")
    i_seeds = seeds.select("i_fpid", F.col("i_lsid").alias("seed"), "salts",
                           *[F.col(f"i_{n}").alias(f"s_{n}") for n in ("x", "y", "th")]).distinct()
    salted = i_seeds.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    i_side = _aligned(salted.join(flat_structures(inputs, "i_").drop("n_i"), "i_fpid"), "i_")
    cells = {"far": ALIGN_DIST, "bearing": ALIGN_ANGLE, "turn": ALIGN_ANGLE}
    for name, size in cells.items():
        t_side = t_side.withColumn(f"{name}_cell", F.floor(F.col(f"t_{name}") / size))
        at = F.floor(F.col(f"i_{name}") / size)
        i_side = i_side.withColumn(f"{name}_cell", F.explode(F.sequence(at - 1, at + 1)))
    near = t_side.join(i_side, ["i_fpid", "seed", "salt", *[f"{name}_cell" for name in cells]])
    for name, size in cells.items():
        near = near.filter(F.abs(F.col(f"t_{name}") - F.col(f"i_{name}")) < size)
    alike, sl = similarity("t_", "i_")
    return near.select(*PAIR, "n_t", "n_i", "rank", "t_lsid", "i_lsid",
                       (F.when(alike, sl).otherwise(0) + 1_000_000).alias("weight"))


def assignment_totals(candidates: DataFrame) -> DataFrame:
    """Greedy one-to-one totals by rounds over all groups at once.

    Each round takes every pair that is the best of both its ends and drops
    what touches them; this is the greedy order, without one task ever
    holding a group. Rounds end when nothing is left.
    """
    group = [*PAIR, "rank"]
    order = [F.desc("weight"), F.desc("t_lsid"), F.desc("i_lsid")]
    best_t = F.row_number().over(Window.partitionBy(*group, "t_lsid").orderBy(*order))
    best_i = F.row_number().over(Window.partitionBy(*group, "i_lsid").orderBy(*order))
    left, taken = cut(candidates), []
    while left.limit(1).count():
        marked = left.withColumn("best", (best_t == 1) & (best_i == 1))
        mine = cut(marked.filter("best").drop("best"))
        taken.append(mine)
        left = cut(left.join(mine.select(*group, "t_lsid"), [*group, "t_lsid"], "left_anti")
                   .join(mine.select(*group, "i_lsid"), [*group, "i_lsid"], "left_anti"))
    chosen = taken[0] if taken else left
    for more in taken[1:]:
        chosen = chosen.unionByName(more)
    size = F.greatest("n_t", "n_i").alias("size")
    totals = chosen.groupBy(*group, size).agg(F.sum("weight").alias("total"))
    return totals.groupBy(*PAIR, "size").agg(F.max("total").alias("total")).select(*PAIR, "total", "size")
