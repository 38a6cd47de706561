"""Exact n-gram Jaccard join in metric space.

1. Each text is its set of distinct shingles; equal sets are one from here on.
2. Two sets within the distance bound share a shingle among the first few of
   each, in any fixed order of shingles. The order is rarest first, from a
   sketch of document frequencies over the whole corpus, so common passages
   come last. Sets that share such a shingle meet.
3. Where sets meet, one of them is the pivot of a region, and the others belong
   to it; sizes cut a region further, as linked sets have similar sizes.
4. The distance of each member from its pivot is computed. Members within the
   bound are linked to it: they, and the cells that any of them came from, are
   one cell, known to be connected. A member that no pivot reached is a cell of
   its own. Only pairs of different cells are open, and they can only be linked
   if their distances from the pivot differ by the bound at most, so only members
   with such a distance from another cell are replicated into the next round: a
   region of the rest, with a new pivot. Regions of a bounded size are finished
   in one task; those which stay large after ROUNDS are finished in pairs of blocks.
5. Links make components. Distances are compared as whole numbers.

Words are runs of bytes other than blanks and tabs to carriage returns, A-Z in
lower case. Null texts and texts without words have an empty set and are linked
with nothing. Repeated rows are linked; a null doc_id joins a component but
never names it. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.llm.common import (NOT_SPACE, Words, binaries, bit_table, bits_at, mix, shingles, signed, stored,
                                  text_slices)
from ridgemark.llm.components import components

SIZE = 4                        # words of a shingle
LINK = (85, 100)                # least intersection over union
SKETCH_BITS = 18
FILTER_BITS = 24
KEY_BITS = 26
REGION = 500_000              # shingles that one task finishes
ROUNDS = 4


class Sets:
    """Distinct shingles of the texts of a slice, sorted in each text."""

    def __init__(self, data, offsets, size: int):
        docs, hashes = shingles(Words(data, offsets, NOT_SPACE), size)
        n = len(offsets) - 1
        order = np.argsort((docs.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)), kind="stable")
        docs, hashes = docs[order], hashes[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
        self.docs, self.hashes = docs[new], hashes[new]
        self.first = np.searchsorted(self.docs, np.arange(n + 1))
        self.counts = np.diff(self.first)

    def numbers(self) -> np.ndarray:
        """Two 64-bit numbers for each set."""
        out = np.zeros((len(self.counts), 2), np.uint64)
        full = np.flatnonzero(self.counts)
        if len(full):
            for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                out[full, k] = mix(np.add.reduceat(mix(self.hashes ^ np.uint64(salt)), self.first[full])
                                   + self.counts[full].astype(np.uint64))
        return out

    def ids(self) -> pa.Array:
        """128 bits for each set; null for an empty one."""
        out = self.numbers()
        values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(out), [None, pa.py_buffer(out.tobytes())])
        return pa.array(values.cast(pa.binary()).to_pylist(), pa.binary(), mask=self.counts == 0)


def _least_common(n: int | np.ndarray, link: tuple[int, int]):
    """Shingles that a set of n must share with any set linked to it."""
    return (link[0] * n + link[1] - 1) // link[1]


def _spare(n: int | np.ndarray):
    """Shingles listed beyond the least number; linked sets share one more for each of them."""
    return n // 16


def frequency_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Document frequencies of all shingles, by hash bucket: a table of fixed size."""
    blocks, width = 16, (1 << SKETCH_BITS) // 16

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                hashes = Sets(data, offsets, size).hashes
                total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(blocks), pa.int32()), binaries(total.view(np.uint8), np.arange(blocks + 1) * width * 8)],
            ["block", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n.tobytes()], pa.binary())], ["block", "n"])

    rows = (docs.select(F.col("text").cast("string")).mapInArrow(count, "block int, n binary")
            .repartition(blocks, "block").mapInArrow(add, "block int, n binary").collect())
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        out[r["block"] * width:(r["block"] + 1) * width] = np.frombuffer(r["n"], np.int64)
    return out


def profiles(docs: DataFrame, sketch: np.ndarray, size: int, link: tuple[int, int]) -> DataFrame:
    """doc_id, set id, set size and the shingles on which the set must meet any set linked to it.

    A task lists the shingles of a set once, so copies cost little more than their ids.
    """
    ranks = np.minimum(np.log2(sketch + 1) * 1024, 65535).astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        known = np.zeros(0, np.uint64)          # sets that this task has filed
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                sets = Sets(data, offsets, size)
                own = sets.numbers()[:, 0]
                fresh = np.zeros(len(own), bool)
                fresh[np.unique(own, return_index=True)[1]] = True
                fresh &= ~np.isin(own, known)
                known = np.union1d(known, own)
                rank = shared.value[(sets.hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort((sets.docs.astype(np.uint64) << np.uint64(48)) | (rank << np.uint64(32))
                                   | (sets.hashes & np.uint64(0xFFFFFFFF)), kind="stable")
                place = np.arange(len(order)) - sets.first[sets.docs]
                prefix = np.where(fresh & (sets.counts > 0), sets.counts - _least_common(sets.counts, link) + 1 + _spare(sets.counts), 0)
                prefix = np.minimum(prefix, sets.counts)
                keep = place < prefix[sets.docs]
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]), pa.int32()),
                                                pa.array(signed(sets.hashes[order][keep])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets.counts)), sets.ids(), pa.array(sets.counts, pa.int64()), keys],
                    ["doc_id", "sid", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, sid binary, n long, keys array<long>")


def _filter_bits(ids: list[bytes] | np.ndarray) -> np.ndarray:
    both = np.frombuffer(b"".join(ids), np.uint64).reshape(-1, 2) >> np.uint64(64 - FILTER_BITS)
    return both.astype(np.int64)


def wanted_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(sid, shingles) of the wanted set ids, once each.

    A filter of fixed size over the wanted ids, which lets some others pass, is
    broadcast, so few sets are shuffled for the join that decides.
    """
    bits = bit_table(wanted, lambda batch: _filter_bits(batch.column(0).to_pylist()).ravel(), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits, known = shared.value, set()
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                sets = Sets(data, offsets, size)
                ids = sets.ids().to_pylist()
                full = np.flatnonzero(sets.counts)
                if not len(full):
                    continue
                at = _filter_bits([ids[d] for d in full])
                good = []
                for d in full[bits_at(bits, at).all(1)].tolist():
                    if ids[d] not in known:
                        known.add(ids[d])
                        good.append(d)
                if good:
                    values = [sets.hashes[sets.first[d]:sets.first[d + 1]].tobytes() for d in good]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[d] for d in good], pa.binary()), pa.array(values, pa.binary())], ["sid", "set"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "sid binary, set binary")
    return found.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("set").alias("set"))


def _key_place(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def meeting_rows(profile: DataFrame, link: tuple[int, int]) -> DataFrame:
    """(sid, n, key) of the shingles on which sets can meet a linked set.

    Most shingles are listed once. Those listed twice set bits in a filter of
    fixed size, which is broadcast; what it lets pass in vain costs a row only.
    A set is left out if too few of its listed shingles are met: linked sets
    share as many as the smaller of them lists beyond the least number, and one.
    """
    twice = profile.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1").select("key")

    bits = bit_table(twice, lambda batch: _key_place(batch.column(0).to_numpy()), KEY_BITS)
    shared = profile.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits = shared.value
        for batch in batches:
            lists, n = batch.column(2), batch.column(1).to_numpy()
            keys = lists.flatten().to_numpy()
            owner = pa.compute.list_parent_indices(lists).to_numpy()
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            at = _key_place(keys)
            met = bits_at(bits, at)
            enough = np.bincount(owner[met], minlength=len(n)) > _spare(_least_common(n, link))
            good = np.flatnonzero(met & enough[owner])
            first = place[good] <= (n - _least_common(n, link))[owner[good]]
            own = pa.array(owner[good])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(keys[good]), pa.array(first, pa.bool_())],
                ["sid", "n", "key", "first"])

    listed = profile.select("sid", "n", "keys").filter("n > 0 and size(keys) > 0").mapInArrow(
        run, "sid binary, n long, key long, first boolean")
    rows = stored(listed.distinct())
    # The same once more among the sets that are left, now exactly.
    twice = rows.groupBy("key").count().filter("count > 1").select("key")
    rows = rows.join(twice, "key", "left_semi")
    spare = F.floor(F.floor((link[0] * F.col("n") + link[1] - 1) / link[1]) / 16)
    enough = rows.groupBy("sid", "n").agg(F.count("*").alias("c")).filter(F.col("c") > spare).select("sid")
    return rows.filter("first").join(enough, "sid", "left_semi").select("sid", "n", "key")


def regions(profile: DataFrame, link: tuple[int, int]) -> DataFrame:
    """(sid, region) of the sets that meet others: region is its pivot's id with a size class."""
    width = float(np.log(link[1] / link[0]))
    # Sizes of linked sets lie in one class or in neighbours: each set enters its own and the next.
    level = F.floor(F.log("n") / width + 1e-9).cast("int")
    classed = stored(meeting_rows(profile, link).select("sid", "key", F.explode(F.array(level, level + 1)).alias("level")))
    pivots = (classed.groupBy("key", "level").agg(F.min("sid").alias("pivot"), F.count("*").alias("c"))
              .filter("c > 1").drop("c"))
    return (classed.join(pivots, ["key", "level"])
            .select("sid", F.concat("pivot", F.encode(F.col("level").cast("string"), "utf-8")).alias("region")).distinct())


def _common(a: np.ndarray, b: np.ndarray) -> int:
    k = np.searchsorted(b, a)
    k[k == len(b)] = 0
    return int((b[k] == a).sum()) if len(b) else 0


def _measure(rows: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Adds to each (region, sid, set, pivot, pivot_set, cell): linked, and the distance in millionths."""
    def run(batches):
        for batch in batches:
            linked, far = [], []
            for a, b in zip(batch.column(2), batch.column(4)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = _common(x, y) if len(x) <= len(y) else _common(y, x)
                union = len(x) + len(y) - both
                linked.append(link[1] * both >= link[0] * union)
                far.append((union - both) * 1_000_000 // union)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(linked, pa.bool_()), pa.array(far, pa.int64()),
                 batch.column(5)], ["region", "sid", "pivot", "linked", "far", "cell"])

    return rows.select("region", "sid", "set", "pivot", "pivot_set", "cell").mapInArrow(
        run, "region binary, sid binary, pivot binary, linked boolean, far long, cell int")


def _open(measured: DataFrame, step: int, bound: int) -> DataFrame:
    """(region, sid, cell) of the members that may be linked with one of another cell after round ``step``.

    What the pivot is linked with, and the cells which that came from, become
    the cell ``step``; a null cell is one of its own. The pivot itself has met all.
    """
    at, new = F.col("cell"), F.col("linked") & (F.col("sid") != F.col("pivot"))
    groups = [(at == k, F.when(F.bool_or(F.col("linked") & (at == k)), step).otherwise(k)) for k in range(step)]
    groups += [(at.isNull() & new, F.lit(step)), (at.isNull() & ~F.col("linked"), F.lit(None).cast("int"))]
    spans = [F.struct(label.cast("int").alias("label"), F.min(F.when(own, F.col("far"))).alias("low"),
                      F.max(F.when(own, F.col("far"))).alias("high")) for own, label in groups]
    known = measured.join(measured.groupBy("region").agg(F.array(*spans).alias("spans")), "region")
    cell = F.when(F.col("linked"), F.lit(step)).otherwise(F.get("spans", at)["label"])
    near = F.exists("spans", lambda s: (s["label"].isNull() | (s["label"] != F.col("now")))
                    & (s["low"] <= F.col("far") + bound) & (s["high"] >= F.col("far") - bound))
    return (known.filter("sid != pivot").withColumn("now", cell).filter(F.col("now").isNull() | near)
            .select("region", "sid", F.col("now").alias("cell")))


def finish(ids: list[bytes], sets: list[np.ndarray], cells: list[int | None], link: tuple[int, int]) -> list[tuple[bytes, bytes]]:
    """Links that join the sets of one bounded region.

    Sets of one cell are connected already, and so are those that links found
    here connect; all other pairs of possible sizes are compared. A set without
    a cell is one of its own. A set whose shingles mostly occur in no other set
    of the region is linked with none.
    """
    links: list[tuple[bytes, bytes]] = []
    alive = np.arange(len(sets))
    while True:
        sizes = np.array([len(sets[i]) for i in alive])
        flat = np.concatenate([sets[i] for i in alive]) if len(alive) else np.zeros(0, np.uint64)
        _, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(alive)), sizes)
        twice = np.bincount(owner, weights=n[inverse] > 1, minlength=len(alive))
        keep = twice >= _least_common(sizes, link)
        alive = alive[keep]
        if keep.all() or not len(alive):
            break
    # Sets are taken in the order of size, so the possible partners of one among those after it are one run.
    order = np.argsort([len(sets[i]) for i in alive], kind="stable")
    alive = alive[order]
    sizes = np.array([len(sets[i]) for i in alive])
    label = np.array([-1 - i if cells[i] is None else cells[i] for i in alive])
    for p in range(len(alive)):
        high = np.searchsorted(sizes, sizes[p] * link[1] // link[0], "right")
        others = np.flatnonzero(label[p + 1:high] != label[p]) + p + 1
        if not len(others):
            continue
        part = np.concatenate([sets[alive[q]] for q in others])
        mine = sets[alive[p]]
        k = np.searchsorted(mine, part)
        k[k == len(mine)] = 0
        both = np.add.reduceat((mine[k] == part).astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        union = sizes[others] + sizes[p] - both
        for q in others[link[1] * both >= link[0] * union]:
            if label[q] != label[p]:
                links.append((ids[alive[p]], ids[alive[q]]))
                label[label == label[q]] = label[p]
    return links


def _finished(rows: DataFrame, keys: list[str], link: tuple[int, int]) -> DataFrame:
    """Links inside groups of (…, sid, cell, set) of a bounded size."""
    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("set")]
        ids = group.column("sid").to_pylist()
        found = finish(ids, sets, group.column("cell").to_pylist(), link)
        return pa.table([pa.array([u for u, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["u", "v"])

    return rows.select(*keys, "sid", "cell", "set").groupBy(*keys).applyInArrow(run, "u binary, v binary")


def links(docs: DataFrame, profile: DataFrame, size: int = SIZE, link: tuple[int, int] = LINK) -> DataFrame:
    """(u, v) set ids whose components are those of all links."""
    members = stored(regions(profile, link))
    wanted = members.select("sid").distinct()
    sets = stored(wanted_sets(docs, wanted, size).withColumn("n", F.octet_length("set") / F.lit(8)))
    bound = 1_000_000 * (link[1] - link[0]) // link[1] + 1
    found = []
    left = members.withColumn("cell", F.lit(None).cast("int"))
    for step in range(ROUNDS):
        free = F.min(F.when(F.col("cell").isNull(), F.col("sid")))      # of no cell, as long as there are such
        pivots = left.groupBy("region").agg(F.coalesce(free, F.min("sid")).alias("pivot"))
        measured = stored(_measure(
            left.join(sets.select("sid", "set"), "sid").join(
                pivots.join(sets.select(F.col("sid").alias("pivot"), F.col("set").alias("pivot_set")), "pivot"), "region"), link))
        found.append(measured.filter("linked and sid != pivot").select(F.col("sid").alias("u"), F.col("pivot").alias("v")))
        left = _open(measured, step, bound)
        cells = F.count_if(F.col("cell").isNull()) + F.coalesce(F.bit_count(F.bit_or(F.expr("shiftleft(1, cell)"))), F.lit(0))
        weight = left.join(sets.select("sid", "n"), "sid").groupBy("region").agg(F.sum("n").alias("w"), cells.alias("c"))
        weight = stored(weight.filter("c > 1"))
        left = stored(left.join(weight.select("region"), "region"))
        small = weight.filter(F.col("w") <= REGION).select("region")
        found.append(_finished(left.join(small, "region").join(sets.select("sid", "set"), "sid"), ["region"], link))
        large = weight.filter(F.col("w") > REGION)
        left = left.join(large.select("region"), "region")
        if large.isEmpty():
            break
    else:
        blocks = F.ceil(F.col("w") * 2 / REGION).cast("int")
        cut_up = left.join(large, "region").withColumn("blocks", blocks).withColumn(
            "own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        paired = cut_up.select("region", "sid", "cell", F.col("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        paired = paired.select("region", "sid", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        found.append(_finished(paired.join(sets.select("sid", "set"), "sid"), ["region", "a", "b"], link))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components_of(docs: DataFrame, size: int = SIZE, link: tuple[int, int] = LINK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    everything = stored(profiles(docs, frequency_sketch(docs, size), size, link))
    roots = components(links(docs, everything, size, link))
    rooted = everything.select("doc_id", "sid", "n").join(roots, F.col("sid") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "sid").alias("root"))
    names = rooted.filter("root is not null").groupBy(F.col("root").alias("named")).agg(F.min("doc_id").alias("smallest"))
    return rooted.join(names, F.col("root") == F.col("named"), "left").select(
        "doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))
