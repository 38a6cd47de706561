"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text is encoded by a byte-level BPE (A, given a space and the text) and by a
piece model (B, which adds that space itself). Byte offsets where tokens of both
end are common ends; they cut the tokens into groups. Per text the shorter list
of ends drives a galloping search into the longer one: from a guessed place the
step doubles until the end is bracketed, then the bracket is halved. The rank
found for an end, less the rank of the end before, is the range of tokens that a
token overlaps.

A long text is encoded in pieces: it is cut before a blank that follows a character
that is no white space and precedes others. No token of A spans such a place, and
none of B does if no piece of the model holds a blank behind another character,
which is checked. A run without blanks is never cut.

How many texts hold a pair of ids linked is counted over all texts. Counts of
the most frequent pairs, at most ``HEAVY`` of them, are broadcast; the others,
none of which is frequent, are joined, so no size of the corpus changes results.

Null and empty texts, and texts that the tokens of A or B do not spell byte by
byte, have no tokens: zeros and an empty digest. Repeated rows are counted and
returned once each; other columns are not looked at; an empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from ridgemark.llm.bpe import byte_symbols, read_spec
from ridgemark.llm.common import SLICE_BYTES, cut, stored, worker_cache

CUT = regex.compile(r"(?<=\S) (?=[\s\S])")
BLANK = "▁"
BYTE = regex.compile(r"<0x([0-9A-F]{2})>")
# The split of a byte-level BPE into words, a fixed pattern of that kind of tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 18                 # characters
HEAVY = 1 << 20
COUNTED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str, piece: int = PIECE):
        vocab, _, special = read_spec(a_path)
        value = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(value[c] for c in t): i for t, i in vocab.items() if t not in special}
        # The order of merges is the order of ids, so this encoder gives the ids of the file's own library.
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in pieces]
        self.sizes = [np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        # Printed ids: A inside a group and at its end, then B.
        self.shown = [b"%d%s" % (i, mark) for side, marks in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";")))
                      for mark in marks for i in range(len(side))]
        self.piece = piece if not any(regex.search(f"[^{BLANK}]{BLANK}", p) for p in pieces) else None

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self.piece is not None and len(text) - at > self.piece and (m := CUT.search(text, at + self.piece)):
            yield text[at:m.start()]
            at = m.end()
        yield text[at:]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of A and B as little-endian 32-bit numbers; empty if they do not spell the text."""
        found: list[tuple[bytes, bytes]] = []
        for piece in self.pieces(text) if text else ():
            a = self.a.encode_to_numpy(" " + piece, disallowed_special=())
            b = self.b.encode(piece)
            raw = b" " + piece.encode()
            if not raw == b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b"".join(map(self.b_bytes.__getitem__, b)):
                return b"", b""
            found.append((a.astype("<i4").tobytes(), np.array(b, "<i4").tobytes()))
        return b"".join([a for a, _ in found]), b"".join([b for _, b in found])


def gallop(ends: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place in [low, high) whose end is not below the wanted one; the last end never is.

    All searches go at once: steps double away from the guess until the place is
    bracketed, then every bracket is halved.
    """
    at = np.clip(guess, low, high - 1)
    ahead = ends[at] < wanted
    left, right = np.where(ahead, at + 1, low), np.where(ahead, high - 1, at)
    far, step = np.flatnonzero(left < right), 1
    while len(far):
        up = ahead[far]
        probe = np.where(up, np.minimum(at[far] + step, right[far]), np.maximum(at[far] - step, left[far]))
        below = ends[probe] < wanted[far]
        left[far[below]] = probe[below] + 1
        right[far[~below]] = probe[~below]
        # Upwards an end not below closes the bracket; downwards one below does.
        far = far[(up == below) & (left[far] < right[far])]
        step *= 2
    wide = np.flatnonzero(left < right)
    while len(wide):
        middle = (left[wide] + right[wide]) // 2
        below = ends[middle] < wanted[wide]
        left[wide[below]] = middle[below] + 1
        right[wide[~below]] = middle[~below]
        wide = wide[left[wide] < right[wide]]
    return left


def overlaps(short: np.ndarray, s_at: np.ndarray, long: np.ndarray, l_at: np.ndarray):
    """(first, last, common) per token of the shorter side.

    ``short`` and ``long`` are ends of tokens, text after text; ``s_at`` and
    ``l_at`` hold the first token of each text and the total. The token overlaps
    the tokens first to last of the other side; ``common`` says that it ends with
    the last of them.
    """
    n_s, n_l = np.diff(s_at), np.diff(l_at)
    doc = np.repeat(np.arange(len(n_s)), n_s)
    rank = np.arange(len(short)) - s_at[:-1][doc]
    guess = l_at[:-1][doc] + rank * n_l[doc] // np.maximum(n_s[doc], 1)
    last = gallop(long, l_at[:-1][doc], l_at[1:][doc], guess, short)
    common = long[last] == short
    first = np.empty_like(last)
    first[1:] = last[:-1] + common[:-1]
    first[rank == 0] = l_at[:-1][doc[rank == 0]]
    return first, last, common


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, ``counts`` of each."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Aligned:
    """Groups and links of some texts."""

    def __init__(self, pair: Pair, found: list[tuple[bytes, bytes]]):
        self.ids, self.at, ends = [], [], []
        for side in range(2):
            counts = np.array([len(f[side]) // 4 for f in found], np.int64)
            self.ids.append(np.frombuffer(b"".join([f[side] for f in found]), "<i4").astype(np.int64))
            self.at.append(np.append(0, np.cumsum(counts)))
            ends.append(np.cumsum(pair.sizes[side][self.ids[side]]))
        self.n = [np.diff(a) for a in self.at]
        # In texts where A has fewer tokens A drives the search, in the others B.
        self.closes = [np.zeros(len(i), bool) for i in self.ids]
        links = []
        for s in range(2):
            mine = np.flatnonzero(self.n[0] <= self.n[1] if s == 0 else self.n[0] > self.n[1])
            own = [_spread(self.at[k][mine], self.n[k][mine]) for k in (s, 1 - s)]
            starts = [np.append(0, np.cumsum(self.n[k][mine])) for k in (s, 1 - s)]
            if not len(own[0]):
                continue
            first, last, common = overlaps(ends[s][own[0]], starts[0], ends[1 - s][own[1]], starts[1])
            self.closes[s][own[0][common]] = True
            self.closes[1 - s][own[1][last[common]]] = True
            counts = last - first + 1
            both = np.repeat(own[0], counts), own[1][_spread(first, counts)]
            links.append(both if s == 0 else both[::-1])
        self.links = [np.concatenate(x) for x in zip(*links)] if links else [np.zeros(0, np.int64)] * 2

    def doc_of_links(self) -> np.ndarray:
        return np.searchsorted(self.at[0], self.links[0], "right") - 1

    def groups(self) -> np.ndarray:
        """Number of groups of each text."""
        return np.diff(np.append(0, np.cumsum(self.closes[0]))[self.at[0]])

    def shown(self, pair: Pair):
        """The groups of each text as one byte string."""
        inside = [np.cumsum(c) - c for c in self.closes]
        a_ends, b_ends = (np.append(0, np.flatnonzero(c) + 1) for c in self.closes)
        codes = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        va, vb = len(pair.a_bytes), len(pair.b_bytes)
        codes[np.arange(len(self.ids[0])) + b_ends[inside[0]]] = self.ids[0] + va * self.closes[0]
        codes[np.arange(len(self.ids[1])) + a_ends[inside[1] + 1]] = 2 * va + self.ids[1] + vb * self.closes[1]
        edges = (self.at[0] + self.at[1]).tolist()
        for lo, hi in zip(edges, edges[1:]):
            yield b"".join(map(pair.shown.__getitem__, codes[lo:hi].tolist()))[:-1]


def _worker(paths) -> Pair:
    kept = worker_cache("alignment")
    if kept.get("paths") != paths:
        kept.update(paths=paths, pair=Pair(*paths))
    return kept["pair"]


def _runs(column: pa.Array):
    """(first row, texts) of runs of texts that hold ``SLICE_BYTES`` bytes or are one text; null is empty."""
    texts = pc.fill_null(column, "")
    total = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
    row = 0
    while row < len(texts):
        end = max(int(np.searchsorted(total, total[row] + SLICE_BYTES, "right")) - 1, row + 1)
        yield row, texts.slice(row, end - row).to_pylist()
        row = end


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and its groups: array of (a ids, b ids, first byte, end byte) in the space and text."""
    paths = (a_path, b_path)

    def run(batches):
        for batch in batches:
            pair = _worker(paths)
            for row, texts in _runs(batch.column(1)):
                found = Aligned(pair, [pair.encode(t) for t in texts])
                counts = found.groups()
                parts, ends = [], []
                for side in range(2):
                    cuts = np.append(0, np.flatnonzero(found.closes[side]) + 1)
                    parts.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found.ids[side].astype(np.int32))))
                    ends.append(np.cumsum(pair.sizes[side][found.ids[side]])[found.closes[side]])
                edges = np.append(0, ends[0])
                before = np.repeat(edges[np.cumsum(counts) - counts], counts)
                fields = [parts[0], parts[1], pa.array(edges[:-1] - before), pa.array(edges[1:] - before)]
                groups = pa.StructArray.from_arrays(fields, ["a", "b", "first", "end"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), groups)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), listed], ["doc_id", "groups"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, groups array<struct<a:array<int>, b:array<int>, first:long, end:long>>")


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: its counts, the digest of its groups, its distinct linked pairs and how often each is linked.

    A pair is one number, the id of A times the size of B's vocabulary plus the id of B.
    """
    paths = (a_path, b_path)

    def run(batches):
        for batch in batches:
            pair = _worker(paths)
            width = len(pair.b_bytes)
            span = len(pair.a_bytes) * width
            for row, texts in _runs(batch.column(1)):
                n, found = len(texts), Aligned(pair, [pair.encode(t) for t in texts])
                doc = found.doc_of_links()
                key, times = np.unique(doc * span + found.ids[0][found.links[0]] * width + found.ids[1][found.links[1]],
                                       return_counts=True)
                at = pa.array(np.searchsorted(key, np.arange(n + 1) * span).astype(np.int32))
                digests = [hashlib.sha256(s).hexdigest() if s else "" for s in found.shown(pair)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(found.n[0]), pa.array(found.n[1]), pa.array(found.groups()),
                     pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(at, pa.array(key % span)), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, {COUNTED}, pairs array<long>, times array<int>")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair and n, the number of documents that hold it linked."""
    return links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def _least_heavy(counts: DataFrame, heavy: int) -> int:
    """Smallest power of two that at most ``heavy`` pairs reach (one small aggregate, a row per power)."""
    levels = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("pairs")).collect()
    total, least = 0, 1 << 62
    for r in sorted(levels, key=lambda r: -r["bits"]):
        total += r["pairs"]
        if total > heavy:
            return least
        least = 1 << (r["bits"] - 1)
    return 1


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text."""
    spark = docs.sparkSession
    width = SentencePieceProcessor(model_file=b_path).get_piece_size()
    links = stored(linked(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(links))
    a_of = F.expr(f"pair div {width}")
    best = counts.groupBy(a_of.alias("a")).agg(F.max("n").alias("best"))
    tops = best.toArrow()                                   # at most one row per id of A
    top = np.zeros(max(tops["a"].to_pylist(), default=0) + 1, np.int64)
    top[tops["a"].to_numpy()] = tops["best"].to_numpy()
    least = _least_heavy(counts, heavy)
    known = counts.filter(F.col("n") >= least).toArrow()    # at most ``heavy`` rows
    order = np.argsort(known["pair"].to_numpy())
    shared = spark.sparkContext.broadcast((known["pair"].to_numpy()[order], known["n"].to_numpy()[order], top))
    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def looked_up(rest: bool):
        def run(batches):
            pairs, ns, top = shared.value
            for batch in batches:
                flat, times = batch["pairs"].flatten().to_numpy(), batch["times"].flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), np.diff(batch["pairs"].offsets.to_numpy()))
                at = np.searchsorted(pairs, flat)
                at[at == len(pairs)] = 0
                hit = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
                if rest:
                    yield pa.RecordBatch.from_arrays(
                        [batch["row"].take(pa.array(row[~hit])), pa.array(flat[~hit]), pa.array(times[~hit])], ["row", "pair", "times"])
                    continue
                n = ns[at[hit]]
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                np.add.at(sums[0], row[hit], times[hit] * (n == top[flat[hit] // width]))
                np.add.at(sums[1], row[hit], times[hit] * n)
                yield pa.RecordBatch.from_arrays([batch[c] for c in plain] + [pa.array(s) for s in sums],
                                                 [*plain, "n_best", "count_sum"])
        if rest:
            return links.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long")
        kind = links.schema["doc_id"].dataType.simpleString()
        return links.mapInArrow(run, f"row long, doc_id {kind}, {COUNTED}, n_best long, count_sum long")

    out = looked_up(False)
    if least > 1:
        light = looked_up(True).join(counts.filter(F.col("n") < least), "pair")
        light = light.withColumn("a", a_of).join(F.broadcast(best), "a")
        more = light.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                        F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
