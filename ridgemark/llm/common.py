"""Helpers shared by the text operators: slices of Arrow batches, word hashes, tables.

A slice is a run of whole texts of one Arrow batch, as one byte array with
offsets. Word and substring hashes come from prefix sums of a polynomial modulo
2**64, so that a hash of any span costs three array operations.
"""

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
SLICE_ROWS = 1 << 15
BATCH_ROWS = 2000
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD1342543DE82EF95 | 1
_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
        0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F,
        0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]

# Byte tables. Words are runs of bytes that are not white space, or runs of
# ASCII letters, digits and bytes of non-ASCII characters.
SPACES = [0x20, *range(0x09, 0x0E)]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[SPACES] = False
LETTERS = np.zeros(256, bool)
LETTERS[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 256))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lets Python workers take at most ``rows`` texts at a time, so that their memory stays small beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows that a model may learn from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a temporary one if unset in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder, so that a loop keeps a short lineage and survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """Number of tables that this driver has stored so far."""
    return len(_written)


def release(spark: SparkSession, since: int, *more: str) -> None:
    """Deletes the tables stored after the first ``since`` ones, and other folders that nothing reads any more."""
    for path in [*_written[since:], *more]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _written[since:]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until ``df`` has no column of it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def filter_bits(rows: int, least: int, most: int = 30) -> int:
    """Size of a bit table in which ``rows`` keys set at most one bit in sixteen, as a power of two between the bounds."""
    return min(most, max(least, (16 * max(rows, 1) - 1).bit_length()))


def bit_table(rows: DataFrame, place, bits: int) -> np.ndarray:
    """Packed table of 2**bits bits; those at ``place(batch)`` of the rows are set.

    Each part of the table is made by a task of its own, and the table has a
    fixed size, whatever the rows.
    """
    parts = 64
    width = (1 << bits) // parts

    def deal(batches):
        for batch in batches:
            at = np.unique(place(batch))
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))],
                                             ["part", "at"])

    def mark(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part).tolist():
                found.setdefault(p, np.zeros(width, bool))[at[part == p]] = True
        for p, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())],
                                             ["part", "bits"])

    out = np.zeros((parts, width // 8), np.uint8)
    dealt = rows.mapInArrow(deal, "part int, at int").repartition(parts, "part")
    for r in dealt.mapInArrow(mark, "part int, bits binary").collect():       # the parts of the table, once each
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def bits_at(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_ODD[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(_ODD[1])
    x ^= x >> np.uint64(31)
    return x


_tables: dict = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _tables[base] = tuple(both)
    return _tables[base]


_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Spans:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray, second: bool = False):
        values, base = (BYTE_VALUES2, _BASE2) if second else (BYTE_VALUES, _BASE)
        power, self.inverse = _powers(base, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[:len(data)], out=self.prefix[1:])

    def hash(self, start, end) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def rolling(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each position."""
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


_kept: dict = {"owner": None, "values": {}}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks; the next operator's tasks let go of it."""
    if _kept["owner"] != owner:
        _kept.update(owner=owner, values={})
    return _kept["values"]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts that hold ``limit`` bytes or are one text; null is empty."""
    worker_cache("slices")
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), row + SLICE_ROWS, n)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Words:
    """The words of a slice: spans, hashes and owning texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True):
        inside = np.empty(len(data) + 2, bool)
        inside[0] = inside[-1] = False
        np.take(word_bytes, data, out=inside[1:-1])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.start, offsets)      # first word of each text, and the total
        self.counts = np.diff(self.first)
        self.hash = Spans(LOWER[data] if lower else data).hash(self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def sequence_hash(words: np.ndarray, picks: list[int]) -> np.ndarray:
    """Hash of the words at the given distances from each place where all of them exist."""
    n = len(words) - picks[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, p in enumerate(picks):
        total += words[p:p + n] * np.uint64(_ODD[k % len(_ODD)] + 2 * (k // len(_ODD)))
    return mix(total)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of k words inside a text; a shorter text that has words is one run."""
    hashes = sequence_hash(words.hash, list(range(k)))
    doc = words.doc()
    inside = doc[:len(hashes)] == doc[k - 1:] if len(hashes) else np.zeros(0, bool)
    docs, hashes = doc[:len(hashes)][inside], hashes[inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        total = np.full(len(short), 0x5851F42D4C957F2D, np.uint64)
        for j in range(k - 1):
            has = words.counts[short] > j
            at = words.first[short][has] + j
            total[has] = mix(total[has] * np.uint64(_ODD[2]) + words.hash[at])
        docs, hashes = np.concatenate([docs, short]), np.concatenate([hashes, total])
    return docs, hashes


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column whose values are runs of ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)),
                                  pa.py_buffer(np.ascontiguousarray(data))])
