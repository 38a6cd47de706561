"""Removal of repeated substrings with a logarithmic family of suffix arrays.

Every text is cut into the windows of LENGTH bytes. Each window is filed under
its anchor: the position inside it whose GRAM bytes have the smallest hash (the
leftmost of equals), so equal windows have equal anchors. Neighbouring windows
with the same anchor are one block, and a block's entry is the suffix at its
anchor, with the hash of the whole block. One entry stands for about 85
suffixes; sorted by the order of hashes they are a sparse suffix array.

The corpus comes in batches. The suffix array of a new batch is merge-scanned
with the arrays of all levels: neighbours in the merged order with equal blocks
are matches of all their windows, and neighbours with equal anchors but other
blocks are matches of some of their windows at most. Then the batch becomes a
level, and equal-sized levels are merged into one of twice the size. Blocks
that meet others only at the anchor are resolved window by window.

Texts are UTF-8 bytes, null is an empty text. Texts are known by a 64-bit hash,
so exact copies share their results; different texts that share one are found by
a second hash and known by another. Texts below LENGTH bytes lose nothing.
Other columns, and null or repeated ids, are carried along.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgemark.llm.common import Spans, bit_table, bits_at, filter_bits, free_names, mix, signed, stored, text_slices

LENGTH = 200
GRAM = 32
BATCHES = 4
FILTER_BITS = 24               # at least; more for more meetings
GATHER = 200_000               # entries that a task looks through for repeats
GROUP = 20_000                 # blocks of one anchor that one task resolves
FOUND = "kind int, key long, block long, tid long, start int, windows int"
MATCH, MEETING, LEVEL, ENTRY_ROW = 0, 1, 2, 3


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        values, have = np.minimum(values[:-have], values[have:]), have * 2
    return np.minimum(values[:len(values) - (width - have)], values[width - have:]) if width > have else values


class Blocks:
    """The blocks of the texts of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, empty = data, np.zeros(0, np.int64)
        self.start = self.end = self.text = empty
        self.key = self.block = np.zeros(0, np.uint64)
        if len(data) < LENGTH:
            return
        spans = Spans(data)
        grams = spans.rolling(GRAM)
        order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(order, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        last = np.repeat(offsets[1:], np.diff(offsets))[:len(anchor)] - LENGTH      # last window of the text
        at = np.arange(len(anchor))
        inside = at <= last
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        self.start = np.flatnonzero(new & inside)
        if not len(self.start):
            return
        ends = np.ones(len(anchor), bool)
        ends[:-1] = (anchor[1:] != anchor[:-1]) | ~inside[1:]
        self.end = np.flatnonzero(ends & inside)                                    # last window of the block
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.key = grams[anchor[self.start]]
        self.block = spans.hash(self.start, self.end + LENGTH) ^ mix((anchor[self.start] - self.start).astype(np.uint64))


def entries(docs: DataFrame) -> DataFrame:
    """The suffix entries of texts given as (tid, text).

    Blocks that occur twice among GATHER entries of a task are matches already: they
    are told at once, and one entry of each goes on. So a passage that a large
    part of the corpus holds sends few entries to the task that scans its
    anchor. Told entries are dealt out by their own place.
    """
    def run(batches):
        parts, held = [], 0
        for batch in _with_end(batches):
            tids = batch.column(0).to_numpy() if batch is not None else None
            for row, data, offsets in text_slices(batch.column(1)) if batch is not None else ():
                b = Blocks(data, offsets)
                parts.append((b.key, b.block, tids[row + b.text], (b.start - offsets[b.text]).astype(np.int32),
                              (b.end - b.start + 1).astype(np.int32)))
                held += len(b.key)
            if not parts or batch is not None and held < GATHER:
                continue
            key, block, tid, start, windows = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((block, key))
            k, b = key[order], block[order]
            same = np.zeros(len(order) + 1, bool)
            same[1:-1] = (k[1:] == k[:-1]) & (b[1:] == b[:-1])
            first, told = order[~same[:-1]], order[same[:-1] | same[1:]]
            parts, held = [], 0
            away = mix(tid[told].view(np.uint64) * np.uint64(3) + start[told].astype(np.uint64))
            at = np.concatenate([first, told])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([ENTRY_ROW, MATCH], np.int32), [len(first), len(told)])),
                 pa.array(signed(np.concatenate([key[first], away]))), pa.array(signed(block[at])), pa.array(tid[at]),
                 pa.array(start[at]), pa.array(windows[at])], ["kind", "key", "block", "tid", "start", "windows"])

    return docs.select("tid", "text").mapInArrow(run, FOUND)


def _scan(batches):
    """Walks a sorted run of entries; holds one entry and one block of the last anchor."""
    names = ["key", "block", "tid", "start", "windows"]
    held = None                 # the last row, and whether it equals the one before
    met = None                  # the last distinct block, and whether its anchor had one before

    def rows(kind, columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *[pa.array(c) for c in columns]], ["kind", *names])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        told = cols.pop(0) == MATCH
        if told.any():
            yield rows(MATCH, [c[told] for c in cols[:5]])
            cols = [c[~told] for c in cols]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held[0], cols)]
        key, block, joins = cols[0], cols[1], cols[5]
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (block[1:] == block[:-1])
        same[0] = held is not None and held[1]
        known = int(held is not None)
        # Matches: all rows but the last, which waits for its neighbour.
        hit = np.flatnonzero(same[:-1] | same[1:])
        yield rows(MATCH, [c[hit] for c in cols[:5]])
        # Level rows: the first joining entry of each block.
        lead = joins.copy()
        lead[1:] &= ~(same[1:] & joins[:-1])
        lead[:known] = False
        at = np.flatnonzero(lead)
        yield rows(LEVEL, [c[at] for c in cols[:5]])
        # Distinct blocks whose anchor has another block before or behind.
        at = np.flatnonzero(~same[known:]) + known
        k, b = key[at], block[at]
        if met is not None:
            k, b = np.concatenate([[met[0]], k]), np.concatenate([[met[1]], b])
        if len(k):
            near = np.zeros(len(k), bool)
            near[1:] = k[1:] == k[:-1]
            near[0] = met is not None and met[2]
            both = np.flatnonzero(near[:-1] | near[1:])
            zero = np.zeros(len(both), np.int64)
            yield rows(MEETING, [k[both], b[both], zero, zero.astype(np.int32), zero.astype(np.int32)])
            met = (k[-1], b[-1], bool(near[-1]))
        held = ([c[-1] for c in cols], bool(same[-1]))
    if held is not None and held[1]:
        yield rows(MATCH, [np.array([v]) for v in held[0][:5]])
    if met is not None and met[2]:
        yield rows(MEETING, [np.array([met[0]]), np.array([met[1]]), np.zeros(1, np.int64), np.zeros(1, np.int32),
                             np.zeros(1, np.int32)])


def index_scans(texts: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """What the merge scans of all batches found: matches, meetings and level entries."""
    levels: list[tuple[int, DataFrame]] = []          # (number of batches, entries)
    found = []
    for i in range(batches):
        fresh = entries(texts.filter(F.pmod(F.col("tid"), F.lit(batches)) == i)).withColumn("joins", F.lit(i < batches - 1))
        size, merging = 1, []
        while levels and levels[-1][0] == size:
            merging.append(levels.pop()[1])
            size *= 2
        run = fresh
        for level in merging:
            run = run.unionByName(level.withColumn("joins", F.lit(i < batches - 1)))
        for _, level in levels:
            run = run.unionByName(level.withColumn("joins", F.lit(False)))
        out = stored(run.repartition("key").sortWithinPartitions("key", "block", "joins").mapInArrow(_scan, FOUND))
        levels.append((size, out.filter(F.col("kind") == LEVEL)))
        found.append(out)
    return found


def _filter_place(key: np.ndarray, block: np.ndarray, size: int) -> np.ndarray:
    return (mix(key.view(np.uint64) * np.uint64(3) + block.view(np.uint64)) >> np.uint64(64 - size)).astype(np.int64)


def met_blocks(texts: DataFrame, meetings: DataFrame) -> DataFrame:
    """Content and one place of each distinct block that meets others at its anchor.

    A filter over the meetings, sized by their number, is broadcast. It may let
    other blocks pass; those are real blocks too, and change nothing.
    """
    size = filter_bits(meetings.count(), FILTER_BITS)
    bits = bit_table(meetings.select("key", "block"), lambda batch: _filter_place(
        batch.column(0).to_numpy(), batch.column(1).to_numpy(), size), size)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits = shared.value
        for batch in batches:
            tids = batch.column(0).to_numpy()
            for row, data, offsets in text_slices(batch.column(1)):
                b = Blocks(data, offsets)
                at = _filter_place(b.key, b.block, size)
                good = np.flatnonzero(bits_at(bits, at))
                good = good[np.unique(b.block[good], return_index=True)[1]]
                if not len(good):
                    continue
                raw = data.tobytes()
                content = [raw[s:e + LENGTH] for s, e in zip(b.start[good].tolist(), b.end[good].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(b.key[good])), pa.array(signed(b.block[good])), pa.array(tids[row + b.text[good]]),
                     pa.array((b.start[good] - offsets[b.text[good]]).astype(np.int32)), pa.array(content, pa.binary())],
                    ["key", "block", "tid", "start", "content"])

    rows = texts.select("tid", "text").mapInArrow(run, "key long, block long, tid long, start int, content binary")
    return rows.groupBy("key", "block").agg(F.first(F.struct("tid", "start", "content")).alias("r")).select(
        "key", "block", "r.tid", "r.start", "r.content")


def _window_hashes(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each window of each block."""
    rows, found = [], []
    for row, data, offsets in text_slices(content.cast(pa.binary()).view(pa.string())):
        h = Spans(data).rolling(LENGTH)
        n = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + offsets[owner]
        rows.append(owner + row)
        found.append(h[place])
    return np.concatenate(rows), np.concatenate(found)


def _ranges(tid, start, owner, place, length: int = LENGTH) -> pa.RecordBatch:
    """Runs of neighbouring windows as byte ranges."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    a, z = place[first] if len(first) else place, place[last] if len(first) else place
    o = owner[first] if len(first) else owner
    return pa.RecordBatch.from_arrays(
        [pa.array(tid[o]), pa.array((start[o] + a).astype(np.int32)), pa.array((start[o] + z + length).astype(np.int32))],
        ["tid", "start", "end"])


def _resolve(batches):
    """Windows that occur in two blocks of an anchor, from rows sorted by anchor; holds the last anchor's rows."""
    held = None
    for batch in _with_end(batches):
        table = held
        if batch is not None:
            piece = pa.Table.from_batches([batch])
            table = piece if held is None else pa.concat_tables([held, piece])
        if table is None or not table.num_rows:
            continue
        key = table.column("key").to_numpy()
        cut = table.num_rows if batch is None else int(np.searchsorted(key == key[-1], True))
        held = None if batch is None else table.slice(cut)
        part = table.slice(0, cut).combine_chunks()
        if not cut:
            continue
        owner, h = _window_hashes(part.column("content").combine_chunks())
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        h = mix(h ^ mix(key[:cut].view(np.uint64))[owner])
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        hit = n[inverse] > 1
        yield _ranges(part.column("tid").to_numpy(), part.column("start").to_numpy(), owner[hit], place[hit])


def _with_end(batches):
    yield from batches
    yield None


def window_matches(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """(tid, start, end) of repeated windows inside blocks that meet at an anchor."""
    blocks = stored(blocks)
    counts = blocks.groupBy("key").count()
    crowded = counts.filter(F.col("count") > group).select("key")
    some = counts.filter((F.col("count") > 1) & (F.col("count") <= group)).select("key")
    own = (blocks.join(some, "key", "left_semi").select("key", "tid", "start", "content").repartition("key")
           .sortWithinPartitions("key").mapInArrow(_resolve, "tid long, start int, end int"))

    # An anchor with very many blocks: its windows are dealt out by their own hashes.
    def explode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, h = _window_hashes(batch.column(3))
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            key = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(mix(h ^ mix(key)[owner]))), pa.array(batch.column(1).to_numpy()[owner]),
                 pa.array((batch.column(2).to_numpy()[owner] + place).astype(np.int32))], ["window", "tid", "start"])

    windows = blocks.join(crowded, "key", "left_semi").select("key", "tid", "start", "content").mapInArrow(
        explode, "window long, tid long, start int")
    twice = windows.groupBy("window").count().filter("count > 1").select("window")
    rest = windows.join(twice, "window", "left_semi").select("tid", "start", (F.col("start") + LENGTH).alias("end"))
    return own.unionByName(rest)


def repeated_ranges(texts: DataFrame, batches: int = BATCHES) -> DataFrame:
    """tid and the byte ranges of its text that repeated windows cover."""
    scans = index_scans(texts, batches)
    everything = scans[0]
    for more in scans[1:]:
        everything = everything.unionByName(more)
    whole = everything.filter(F.col("kind") == MATCH).select(
        "tid", "start", (F.col("start") + F.col("windows") - 1 + LENGTH).alias("end"))
    meetings = everything.filter(F.col("kind") == MEETING)
    part = window_matches(met_blocks(texts, meetings))
    return whole.unionByName(part).distinct().groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a set of ranges."""
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _hash(text) -> Column:
    return F.xxhash64(text)


def known_texts(docs: DataFrame, name: str) -> DataFrame:
    """The documents with the hash that their text is known by; different texts have different ones.

    Texts that share their first hash show it by a second one, and take another.
    About one in 10**9 does at 10**11 texts, so the table of such hashes is small.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = docs.select(_hash(text).alias("h"), F.hash(F.lit(1), text).alias("second"))
    shared = stored(both.groupBy("h").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a != b").select("h"))
    if shared.isEmpty():
        return docs.withColumn(name, _hash(text))
    other = free_names(docs, "_shared_")[0]
    marked = docs.withColumn(name, _hash(text)).join(shared.withColumnRenamed("h", other), F.col(name) == F.col(other), "left")
    return marked.withColumn(name, F.when(F.col(other).isNull(), F.col(name)).otherwise(F.xxhash64(F.lit(1), text))).drop(other)


def with_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents with the maximal removed runs as a last column (array of start and end bytes)."""
    names = docs.columns
    tid, found, ranges = free_names(docs, "_tid_", "_found_", "_ranges_")
    known = known_texts(docs, tid)
    texts = known.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(tid).alias("tid"))
    cut = repeated_ranges(texts, batches).select(F.col("tid").alias(found), F.col("ranges").alias(ranges))
    return known.join(cut, F.col(tid) == F.col(found), "left").select(*names, ranges)


def _spans(cell) -> list[tuple[int, int]]:
    return merged([(r["start"], r["end"]) for r in cell.as_py() or []])


def _rest(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, z in spans:
        out.append(raw[at:a])
        at = z
    out.append(raw[at:])
    return b"".join(out)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    def run(batches):
        for batch in batches:
            sizes, removed, spans, sha = [], [], [], []
            for text, cell in zip(batch.column(1), batch.column(2)):
                raw, own = (text.as_py() or "").encode(), _spans(cell)
                sizes.append(len(raw))
                removed.append(sum(z - a for a, z in own))
                spans.append(len(own))
                sha.append(hashlib.sha256(_rest(raw, own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in (sizes, removed, spans)], pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs.select("doc_id", F.col("text").cast("string"))).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes; characters cut in part are dropped, and n_chars is counted anew.

    Documents of which no text is left are dropped. All columns are kept.
    """
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts = []
            for text, cell in zip(columns[at], batch.column(batch.num_columns - 1)):
                own = _spans(cell)
                value = text.as_py()
                texts.append(_rest(value.encode(), own).decode("utf-8", "ignore") if own else value)
            was = columns[at].to_pylist()
            keep = [t is None or bool(t.strip()) or t == w for t, w in zip(texts, was)]
            columns[at] = pa.array(texts, pa.string())
            if count is not None:
                sizes = [n if t == w else len(t) for n, t, w in zip(columns[count].to_pylist(), texts, was)]
                columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return with_spans(docs).mapInArrow(run, schema)
