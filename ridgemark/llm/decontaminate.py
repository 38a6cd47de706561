"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words of a window and ignore the others, so that a
changed word inside a copied passage leaves seeds intact. Training and test
seeds meet by hash; around each meeting the two word sequences are laid over
each other, and the longest stretch in which at least four fifths of the words
agree is the overlap. A document is contaminated by an item if that stretch has
MIN_OVERLAP words, or all the words of a shorter item.

An item of five to seven words also has seeds of four words, so that it is
found with any word changed that leaves four fifths. Words are runs of letters
and digits, A-Z in lower case. Null and empty texts have no words. An item of fewer words than a seed picks (five) is not testable
and matches nothing. Repeated items are compared once and reported each;
repeated documents are reported each. Documents are read once per block of test
items and never shuffled before a match; a block has a bounded size.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.llm.common import LETTERS, Words, sequence_hash, text_slices

# Kept word positions of each mask.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 4, 6, 9), (0, 3, 4, 5, 8))
WEIGHT = 5
# Masks of four words for items of at most SHORT words, which may lack any seed of five when a word is changed.
SHORT_MASKS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
SHORT = 7
MIN_OVERLAP = 13
SIMILARITY = (4, 5)            # at least 4 of 5 words agree
BLOCK_BYTES = 8 << 20          # of test texts that travel to the executors at once
FILTER_BITS = 23
PLACES = 1 << 19               # meetings, or words laid over each other, at once
MATCH = "item_id {kind}, words long, matched long, doc_start long, item_start long"


class Seeds:
    """Seeds of a block of test items, looked up by hash."""

    def __init__(self, texts: list[str]):
        self.words, self.of, self.masks, pos, item, key = [], {}, MASKS, [], [], []
        for row, text in enumerate(texts):
            raw = np.frombuffer(text.encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]), LETTERS).hash
            known = self.of.get(words.tobytes())
            if known is not None:
                known[1].append(row)
                continue
            self.of[words.tobytes()] = (len(self.words), [row])
            short = WEIGHT <= len(words) <= SHORT
            if short:
                self.masks = MASKS + SHORT_MASKS
            for m, mask in enumerate(MASKS + SHORT_MASKS if short else MASKS):
                h = sequence_hash(words, list(mask)) + np.uint64(m)
                key.append(h)
                pos.append(np.arange(len(h)))
                item.append(np.full(len(h), len(self.words)))
            self.words.append(words)
        self.rows = [rows for _, rows in self.of.values()]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, np.int64)
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        del self.of, self.words

    def meetings(self, words: Words) -> Iterator[np.ndarray]:
        """Distinct (document, item, word of the document at which the item would start), PLACES at a time."""
        doc, at, low, n = words.doc(), [], [], []
        for m, mask in enumerate(self.masks):
            h = sequence_hash(words.hash, list(mask)) + np.uint64(m)
            near = np.flatnonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            near = near[doc[near] == doc[near + mask[-1]]]
            at.append(near)
            low.append(np.searchsorted(self.key, h[near]))
            n.append(np.searchsorted(self.key, h[near], "right") - low[-1])
        at, low, n = (np.concatenate(c) for c in (at, low, n))
        order = np.argsort(at, kind="stable")
        order = order[n[order] > 0]
        at, low, n = at[order], low[order], n[order]
        for own in _runs(n):
            size = n[own]
            k = np.repeat(low[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            here = np.repeat(at[own], size)
            yield np.unique(np.stack([doc[here], self.item[k], here - self.pos[k]], 1), axis=0)


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Neighbours whose sizes sum to at most PLACES, or single ones."""
    ends, row = np.cumsum(sizes), 0
    while row < len(sizes):
        end = int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PLACES, "right"))
        yield slice(row, max(end, row + 1))
        row = max(end, row + 1)


def longest(equal: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, equal words) of the longest stretch of each run in which enough words agree; the first of equals."""
    a, b = SIMILARITY
    runs, ends = len(sizes), np.cumsum(sizes + 1)
    first = ends - sizes - 1
    steps = np.zeros(ends[-1] if runs else 0, np.int64)
    steps[np.setdiff1d(np.arange(len(steps)), first, assume_unique=True)] = np.where(equal, b - a, -a)
    sums = np.cumsum(steps)
    sums -= np.repeat(sums[first], sizes + 1)
    # Runs lie at heights that fall from one to the next, so one search serves all of them.
    level = sums + np.repeat(np.arange(runs, 0, -1), sizes + 1) * (2 * b * (int(sizes.max(initial=0)) + 1))
    rest = np.maximum.accumulate(level[::-1])[::-1]
    last = np.searchsorted(-rest, -level, "right") - 1
    length = last - np.arange(len(level))
    top = np.flatnonzero(length == np.repeat(np.maximum.reduceat(length, first) if runs else length, sizes + 1))
    start = top[np.searchsorted(top, first)]
    end = last[start]
    return start - first, end - first, (sums[end] - sums[start] + a * (end - start)) // b


def overlaps(seeds: Seeds, words: Words) -> np.ndarray:
    """Rows of document, item, words, matched, start in the document, start in the item: the best of each pair."""
    best = np.zeros((0, 6), np.int64)
    for met in seeds.meetings(words):
        doc, item, start = met.T
        low, high, own = words.first[doc], words.first[doc + 1], seeds.size[item]
        a, b = np.maximum(0, low - start), np.minimum(own, high - start)
        for rows in _runs(b - a):
            n = (b - a)[rows]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = (words.hash[np.repeat(start[rows] + a[rows], n) + step]
                     == seeds.flat[np.repeat(seeds.first[item[rows]] + a[rows], n) + step])
            s, e, matched = longest(equal, n)
            good = e - s >= np.minimum(MIN_OVERLAP, own[rows])
            here = a[rows] + s
            best = np.concatenate([best, np.stack(
                [doc[rows], item[rows], e - s, matched, start[rows] + here - low[rows], here], 1)[good]])
        order = np.lexsort((best[:, 4], -best[:, 3], -best[:, 2], best[:, 1], best[:, 0]))
        best = best[order]
        new = np.ones(len(best), bool)
        new[1:] = (best[1:, :2] != best[:-1, :2]).any(1)
        best = best[new]
    return best


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the test items in blocks of about BLOCK_BYTES."""
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield [r[0] for r in part], [r[1] for r in part]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item_id of every contaminated pair, with the overlap."""
    spark = docs.sparkSession
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id"))]
    out = None
    for ids, texts in _blocks(items):
        shared = spark.sparkContext.broadcast((ids, Seeds(texts)))

        def run(batches, shared=shared):
            ids, seeds = shared.value
            for batch in batches:
                for row, data, offsets in text_slices(batch.column(1)):
                    found = [(row + d, ids[r], n, m, at, own)
                             for d, i, n, m, at, own in overlaps(seeds, Words(data, offsets, LETTERS)).tolist() for r in seeds.rows[i]]
                    if found:
                        rows, *rest = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(rows)), *[pa.array(c) for c in rest]],
                            ["doc_id", "item_id", "words", "matched", "doc_start", "item_start"])

        part = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
            run, f"doc_id {kinds[0]}, " + MATCH.format(kind=kinds[1]))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no test item contaminates, all columns kept."""
    spark, names = docs.sparkSession, docs.columns
    for _, texts in _blocks(items):
        shared = spark.sparkContext.broadcast(Seeds(texts))

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, data, offsets in text_slices(batch.column(names.index("text"))):
                    keep[row + overlaps(shared.value, Words(data, offsets, LETTERS))[:, 0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
