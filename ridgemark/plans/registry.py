"""Features and consolidations that a caller adds.

A consolidation is four functions over whole arrays, one entry per pair of
fingerprints: ``init`` makes neutral states, ``update`` adds local matches,
``merge`` joins states, ``finish`` turns them into scores. The states are Arrow
columns of any type, nested ones too. Each template row makes one partial state
per probe inside the match map; only where a fingerprint is stored in several
rows do partial states meet, in one hash exchange and a second merge. Results
must not depend on how the matches of a pair are dealt over updates.

Functions of modules that executors cannot import travel by value only if they
are defined inside another function.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.functions.numeric import rounded
from ridgemark.operators import cylinder, jiang, oversize
from ridgemark.operators.align import PAIR
from ridgemark.operators.probes import ProbeSide, probe_shape
from ridgemark.settings import MAX_BROADCAST_LS

KEYS = "t_fpid string, i_fpid string, n_t bigint, n_i bigint"
_KEYS = ("t_fpid", "i_fpid", "n_t", "n_i")


@dataclass(frozen=True)
class Feature:
    """Local structures of one kind and their local matches.

    ``build`` takes print rows and returns ``fpid, chunk, n_chunks, n_ls, ls``;
    ``large`` does so for the flat minutiae of prints beyond the row bound.
    ``prepare`` makes a table of probe rows a block, a tuple that begins with the
    ids (Arrow) and sizes (Arrow). ``match`` takes the ``ls`` column of some
    template rows and a block and yields dicts of arrays: ``row``, ``probe`` (place
    in the ids), ``t_lsid``, ``i_lsid``, ``sl`` (millionths, above zero) and what else
    consolidations of this kind read.
    """
    name: str
    build: Callable[[DataFrame], DataFrame]
    prepare: Callable[[pa.Table], tuple]
    match: Callable[[pa.Array, tuple], Iterator[dict[str, np.ndarray]]]
    large: Callable[[DataFrame], DataFrame] | None = None
    bound: int = 20_000                 # local structures of a probe block


@dataclass(frozen=True)
class Consolidation:
    """Local matches of a pair to one score.

    ``state`` names the state columns and their Spark types. ``init(n)`` gives n
    neutral states as a dict of arrays. ``update(states, matches)`` returns them
    with matches added; ``matches["pair"]`` is the place of each match's state.
    ``merge(states, group, n)`` returns n states, of all states of each group.
    ``finish(states, n_t, n_i)`` returns scores.
    """
    name: str
    feature: str
    state: str
    init: Callable[[int], dict]
    update: Callable[[dict, dict[str, np.ndarray]], dict]
    merge: Callable[[dict, np.ndarray, int], dict]
    finish: Callable[[dict, np.ndarray, np.ndarray], np.ndarray]


def _jiang_matches(column: pa.Array, block: tuple) -> Iterator[dict[str, np.ndarray]]:
    t_row, t = jiang._columns(column)
    _, _, i_row, i = block
    step = max(1, jiang._BLOCK_PAIRS // max(1, len(i_row)))
    for lo in range(0, len(t_row), step):
        a, b, sl = jiang._pairs(t, i, lo, min(lo + step, len(t_row)))
        yield {"row": t_row[a], "probe": i_row[b], "sl": sl,
               **{f"t_{n}": t[n][a] for n in ("lsid", "x", "y", "th")}, **{f"i_{n}": i[n][b] for n in ("lsid", "x", "y", "th")}}


def _cylinder_matches(column: pa.Array, block: tuple) -> Iterator[dict[str, np.ndarray]]:
    t, i = cylinder.Side(column), block[2]
    step = max(1, cylinder._BLOCK_VALUES // max(1, len(i.row)))
    for lo in range(0, len(t.row), step):
        sl = cylinder.similarities(t, i, lo, min(lo + step, len(t.row)))
        a, b = np.nonzero(sl)
        yield {"row": t.row[lo + a], "probe": i.row[b], "sl": sl[a, b],
               **{f"t_{n}": t.m[n][lo + a] for n in ("lsid", "x", "y", "th")},
               **{f"i_{n}": i.m[n][b] for n in ("lsid", "x", "y", "th")}}


FEATURES: dict[str, Feature] = {
    "jiang": Feature("jiang", jiang.jiang_features, jiang.prepared, _jiang_matches, oversize.jiang_features, MAX_BROADCAST_LS["jiang"]),
    "cylinder": Feature("cylinder", cylinder.cylinder_features, cylinder.prepared, _cylinder_matches, oversize.cylinder_features,
                        MAX_BROADCAST_LS["cylinder"])}
CONSOLIDATIONS: dict[str, Consolidation] = {}


def register_feature(feature: Feature) -> None:
    if feature.name in FEATURES:
        raise ValueError(f"feature {feature.name!r} exists")
    FEATURES[feature.name] = feature


def register(consolidation: Consolidation) -> None:
    if consolidation.name in CONSOLIDATIONS:
        raise ValueError(f"consolidation {consolidation.name!r} exists")
    if consolidation.feature not in FEATURES:
        raise ValueError(f"unknown feature {consolidation.feature!r}; one of {sorted(FEATURES)}")
    CONSOLIDATIONS[consolidation.name] = consolidation


def unregister(name: str) -> None:
    """Takes back a consolidation or a feature that a caller added."""
    if CONSOLIDATIONS.pop(name, None) is None and name not in MAX_BROADCAST_LS:
        FEATURES.pop(name, None)


def _columns(batch: pa.RecordBatch, names: list[str]) -> dict[str, pa.Array]:
    return {n: batch[n] for n in names}


def _partial(feature: Feature, own: Consolidation, names: list[str], types, batch: pa.RecordBatch, block: tuple):
    """Rows of partial states of the template rows of a batch with a block of probes."""
    ids, sizes = block[:2]
    pairs, states = [], []
    for found in feature.match(batch["ls"], block):
        pair, at = np.unique(np.asarray(found["row"], np.int64) * len(ids) + found["probe"], return_inverse=True)
        if len(pair):
            pairs.append(pair)
            state = own.update(own.init(len(pair)), {**found, "pair": at})
            states.append([pa.array(state[n], t) for n, t in zip(names, types)])
    if not pairs:
        return None
    pair, group = np.unique(np.concatenate(pairs), return_inverse=True)
    columns = [pa.concat_arrays(c) for c in zip(*states)]
    if len(states) > 1:
        merged = own.merge(dict(zip(names, columns)), group, len(pair))
        columns = [pa.array(merged[n], t) for n, t in zip(names, types)]
    row, probe = pa.array(pair // len(ids)), pa.array(pair % len(ids))
    return pa.RecordBatch.from_arrays(
        [batch["fpid"].take(row), ids.take(probe), batch["n_ls"].take(row), sizes.take(probe), *columns], [*_KEYS, *names])


def _scored(own: Consolidation, names: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    score = own.finish(_columns(batch, names), batch["n_t"].to_numpy(), batch["n_i"].to_numpy())
    return pa.RecordBatch.from_arrays([batch["t_fpid"], batch["i_fpid"], pa.array(np.asarray(score, float))], [*PAIR, "score"])


def _merge_runs(own: Consolidation, names: list[str], types):
    """Merges the states of equal pairs, which stand together in order; a pair at the end of a batch waits for the next."""
    def merged(batch):
        t, i = batch["t_fpid"], batch["i_fpid"]
        new = np.ones(batch.num_rows, bool)
        for c in (t, i):
            v = c.to_numpy(zero_copy_only=False)
            new[1:] &= v[1:] == v[:-1]
        new[1:] = ~new[1:]
        first = pa.array(np.flatnonzero(new))
        state = own.merge(_columns(batch, names), np.cumsum(new) - 1, len(first))
        return pa.RecordBatch.from_arrays([batch[k].take(first) for k in _KEYS] + [pa.array(state[n], y) for n, y in zip(names, types)],
                                          [*_KEYS, *names])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            done = merged(batch)
            held = done.slice(done.num_rows - 1)
            if done.num_rows > 1:
                yield _scored(own, names, done.slice(0, done.num_rows - 1))
        if held is not None:
            yield _scored(own, names, held)
    return run


def registered_scores(templates: DataFrame, inputs: DataFrame, own: Consolidation) -> DataFrame:
    """Scores ``t_fpid, i_fpid, score`` of all pairs with a local match."""
    feature, spark = FEATURES[own.feature], templates.sparkSession
    schema = spark.createDataFrame([], own.state).schema
    names = [f.name for f in schema]
    types = list(spark.createDataFrame([], schema).toArrow().schema.types)
    shape = probe_shape(inputs)
    probes = ProbeSide(inputs, feature.bound, feature.prepare, shape)
    final = not probes.split and not templates.filter("n_chunks > 1").limit(1).count()

    def run(batches):
        for batch in batches:
            for block in probes.blocks():
                part = _partial(feature, own, names, types, batch, block)
                if part is not None:
                    yield _scored(own, names, part) if final else part

    rows = templates.select("fpid", "n_ls", "ls")
    result = "t_fpid string, i_fpid string, score double"
    if final:
        scores = rows.mapInArrow(run, result)
    else:
        states = rows.mapInArrow(run, f"{KEYS}, {own.state}").repartition(*PAIR).sortWithinPartitions(*PAIR)
        scores = states.mapInArrow(_merge_runs(own, names, types), result)
    return scores.select(*PAIR, rounded(F.col("score")).alias("score"))


# --- a consolidation in this form --------------------------------------------

def _sums(values, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def _largest(values, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.maximum.at(out, at, values)
    return out


def _mean_best_merge(states: dict, group: np.ndarray, n: int) -> dict:
    columns = {k: np.asarray(v) for k, v in states.items()}
    return {"matches": _sums(columns["matches"], group, n), "total": _sums(columns["total"], group, n),
            "best": _largest(columns["best"], group, n)}


MEAN_BEST = Consolidation(
    "mean_best", "jiang", "matches bigint, total bigint, best bigint",
    init=lambda n: {k: np.zeros(n, np.int64) for k in ("matches", "total", "best")},
    update=lambda s, m: {"matches": s["matches"] + np.bincount(m["pair"], minlength=len(s["matches"])),
                         "total": s["total"] + _sums(m["sl"], m["pair"], len(s["total"])),
                         "best": np.maximum(s["best"], _largest(m["sl"], m["pair"], len(s["best"])))},
    merge=_mean_best_merge,
    finish=lambda s, n_t, n_i: (np.asarray(s["total"]) / np.asarray(s["matches"]) + np.asarray(s["best"])) / 2e6)
"""Half the mean similarity of all local matches, half the best one."""
register(MEAN_BEST)
