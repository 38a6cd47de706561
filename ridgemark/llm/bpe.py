"""Byte-pair encoding as a bounded-lookahead transducer, and incremental decoding.

Encoding reads a text piece by piece. Inside a word the symbols go through a
window: the merges of the window are applied, and a token is emitted as soon as
no symbol beyond the window can change it. How far that may reach is computed
once from the merge list (``Merges.reach``), so memory does not grow with the
length of a word. Decoding turns ids back into token text, or into the bytes
of the text through an incremental UTF-8 machine.

Null texts encode like empty ones: no tokens. Ids and other columns are not
looked at; repeated rows give repeated results.
"""

import bisect
import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.llm.common import worker_cache

SUFFIX = "</w>"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
# Characters that str.split() takes for white space and the tokenizer does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
WINDOW = 256
CACHE = 150_000
BITS = 20
MASK = (1 << BITS) - 1
NEVER = 1 << 62
BATCH = 4096


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_spec(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]}


class Merges:
    """Vocabulary, merge ranks and the lookahead that each token needs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        symbols = byte_symbols()
        self.special = special
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + SUFFIX] for s in symbols]
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        # The order of a merge and its token in one number.
        self.step = {p: r << BITS | t for p, (r, t) in self.rank.items()}
        self.length = {}
        self.reach = self._reach()

    @classmethod
    def load(cls, path: str) -> "Merges":
        return cls(*read_spec(path))

    def _reach(self) -> dict[int, int]:
        """Symbols behind a token that can still change it.

        A token changes only if a merge crosses its right end before the merge
        that consumes its right part. Such a merge (x, z) needs z to be formed,
        and z may again be changed from its right, by merges of lower rank
        only. Along falling ranks the longest such chain is a sum of lengths.
        """
        length = self.length = {t: 1 for t in self.inner + self.last}
        made: dict[int, tuple[int, int]] = {}          # token: its rank and its right part
        ranks: dict[int, list[int]] = {}               # left part: ranks of its merges
        best: dict[int, list[int]] = {}                # the longest reach up to each of them
        inner: dict[int, int] = {}                     # reach of the merges that cross from inside

        def below(token: int, limit: int) -> int:
            k = bisect.bisect_left(ranks.get(token, []), limit)
            return max(best[token][k - 1] if k else 0, inner.get(token, 0))

        for (x, z), (r, t) in self.rank.items():
            value = length[z] + below(z, r)
            ranks.setdefault(x, []).append(r)
            best.setdefault(x, []).append(max(value, best[x][-1] if best.get(x) else 0))
            if t not in made:
                made[t], length[t] = (r, z), length[x] + length[z]
                inner[t] = below(z, r)
        top = len(self.rank)
        return {t: below(t, top) for t in length}

    def apply(self, ids: list[int]) -> list[int]:
        """All merges inside ``ids``: lowest rank first, then leftmost."""
        get = self.step.get
        pairs = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while pairs:
            low = min(pairs)
            if low == NEVER:
                break
            k, token = pairs.index(low), low & MASK
            ids[k:k + 2] = [token]
            del pairs[k]
            if k:
                pairs[k - 1] = get((ids[k - 1], token), NEVER)
            if k < len(pairs):
                pairs[k] = get((token, ids[k + 1]), NEVER)
        return ids

    def stream(self, word: bytes, window: int = WINDOW) -> Iterator[list[int]]:
        """Tokens of a word, in stable groups, from a window that stays bounded."""
        n, start, size = len(word), 0, window
        while start < n:
            end = min(start + size, n)
            ids = [self.inner[b] for b in word[start:end]]
            if end == n:
                ids[-1] = self.last[word[-1]]
            if len(ids) > 1:
                ids = self.apply(ids)
            if end == n:
                yield ids
                return
            at, keep = start, 0
            for t in ids:
                at += self.length[t]
                if at + self.reach[t] > end:
                    break
                start, keep = at, keep + 1
            size = window if keep else 2 * size      # never beyond the longest reach
            yield ids[:keep]


class Encoder:
    """Texts to ids; pieces and words are remembered, both up to a bound."""

    def __init__(self, merges: Merges, cache: int = CACHE):
        self.merges, self.bound = merges, cache
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None

    def _word(self, word: str) -> bytes:
        symbols = word.encode()
        if len(symbols) > WINDOW:
            return b"".join(np.array(g, "<u4").tobytes() for g in self.merges.stream(symbols))
        inner = self.merges.inner
        ids = [inner[b] for b in symbols]
        ids[-1] = self.merges.last[symbols[-1]]
        out = array("I", self.merges.apply(ids)).tobytes()
        if len(self.words) >= self.bound:
            self.words.clear()
        self.words[word] = out
        return out

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        get, word = self.words.get, self._word
        out = b"".join([get(w) or word(w) for w in PIECES.findall(text.lower())])
        if len(piece) <= 64:
            if len(self.cache) >= self.bound:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def _plain(self, text: str) -> Iterator[bytes]:
        pieces = text.split() if not NOT_SPACE.search(text) else [p for p in SPACE.split(text) if p]
        get, piece = self.cache.get, self._piece
        for k in range(0, len(pieces), BATCH):
            yield b"".join([get(p) or piece(p) for p in pieces[k:k + BATCH]])

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, in runs."""
        at = 0
        if self.marks is not None and "<" in text:
            for m in self.marks.finditer(text):
                yield from self._plain(text[at:m.start()])
                yield self.merges.special[m.group()].to_bytes(4, "little")
                at = m.end()
        yield from self._plain(text[at:] if at else text)


def token_bytes(merges: Merges) -> dict[int, bytes]:
    """The bytes that each token stands for; a word's end is one space."""
    value = {s: b for b, s in enumerate(byte_symbols())}
    out = {}
    for i, t in merges.text.items():
        if t in merges.special:
            out[i] = t.encode()
        else:
            core = t[:-len(SUFFIX)] if t.endswith(SUFFIX) else t
            out[i] = bytes(value[c] for c in core) + b" " * t.endswith(SUFFIX)
    return out


class TextMachine:
    """Ids to text, token by token: holds only the bytes of an unfinished character."""

    def __init__(self, merges: Merges):
        self.bytes = token_bytes(merges)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


class TokenMachine:
    """Ids to the tokens' own strings, one space between them, as the library decodes without a decoder."""

    def __init__(self, shown: dict[int, bytes]):
        self.shown, self.begun = shown, False

    def push(self, ids) -> bytes:
        out = b" ".join(map(self.shown.__getitem__, ids))
        if not out:
            return out
        out, self.begun = (b" " + out if self.begun else out), True
        return out


def _worker(shared):
    """Encoder and token strings of this Python worker, built once."""
    kept = worker_cache("bpe")
    if "encoder" not in kept:
        merges = Merges(*shared.value)
        kept["encoder"] = Encoder(merges)
        kept["shown"] = {i: t.encode() for i, t in merges.text.items()}
    return kept["encoder"], kept["shown"]


def digest(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, and on demand its ids.

    The tokenizer file has a fixed size and is broadcast; texts are neither
    shuffled nor collected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def run(batches):
        encoder, shown = _worker(shared)
        for batch in batches:
            counts, ids_sha, text_sha, listed = [], [], [], []
            for text in batch.column(1):
                n, a, b, machine = 0, hashlib.sha256(), hashlib.sha256(), TokenMachine(shown)
                for run_ in encoder.encode(text.as_py() or ""):
                    n += len(run_) // 4
                    a.update(run_)
                    b.update(machine.push(np.frombuffer(run_, "<u4").tolist()))
                    if ids:
                        listed.append(run_)
                counts.append(n)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)),
                                                        pa.array(np.frombuffer(b"".join(listed), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array) and the text that the ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches):
        encoder, _ = _worker(shared)
        for batch in batches:
            ids, texts = [], []
            for text in batch.column(1):
                machine, own, shown = TextMachine(encoder.merges), [], []
                for run_ in encoder.encode(text.as_py() or ""):
                    own.append(np.frombuffer(run_, "<u4"))
                    shown.append(machine.push(own[-1].tolist()))
                ids.append(np.concatenate(own or [np.zeros(0, np.int32)]).astype(np.int32))
                texts.append("".join(shown) + machine.finish())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())],
                ["doc_id", "ids", "decoded"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string")
