"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones. A letter n-gram is the
product (binding) of its letters' vectors, each rotated by its place; a text is
the sum (bundle) of its n-gram vectors, and a language the sum over its texts.
The language of a text is the one whose prototype has the largest cosine.

Letters are lower-cased runs separated by one blank, so n-grams know word ends.
A text without letters, or null, is ``und`` with score 0. Rows without a
language are not learned from. Repeated rows and other columns do not matter.
Equal cosines: the alphabetically first language.

Learning sums n-gram counts of all learnable documents with map-side
aggregation. What is broadcast is one vector per language.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.llm.common import free_names, held_out, learnable, mix, worker_cache

DIMENSIONS = 512
N = 3
BLANK = 0x20
UNKNOWN = "und"
SLICE_CHARS = 1 << 18
SEED = np.uint64(0x6A09E667F3BCC909)


def _letter_table() -> np.ndarray:
    """For each code point: its lower-case letter, or a blank."""
    points = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            points[c] = ord(low) if len(low) == 1 else c
    return points


def letters() -> np.ndarray:
    kept = worker_cache("langid")
    if "letters" not in kept:
        kept["letters"] = _letter_table()
    return kept["letters"]


def letter_vector(code: int) -> np.ndarray:
    """The random plus and minus ones of a letter."""
    words = mix(np.arange(DIMENSIONS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                + mix(np.array([code], np.uint64) + SEED))
    return np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1


class Vectors:
    """Vectors of n-grams, made when first met; the memory is bounded and starts anew when full."""

    def __init__(self, bound: int = 16_000):
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.bound = bound
        self.store = np.zeros((1024, DIMENSIONS), np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > self.bound:
                self.letters.clear()
            self.letters[code] = letter_vector(code)
        return self.letters[code]

    def _make(self, gram: int) -> np.ndarray:
        out = np.ones(DIMENSIONS, np.int8)
        for k in range(N):                      # the last letter is not rotated
            out = out * np.roll(self._letter(gram & 0x1FFFFF), k)
            gram >>= 21
        return out

    def get(self, grams: list[int]) -> np.ndarray:
        """Row numbers in ``store`` of the given distinct n-grams."""
        if len(self.rows) + len(grams) > self.bound:
            self.rows.clear()
        rows, have = [], self.rows
        for g in grams:
            r = have.get(g)
            if r is None:
                r = have[g] = len(have)
                if r >= len(self.store):
                    self.store = np.concatenate([self.store, np.zeros_like(self.store)])
                self.store[r] = self._make(g)
            rows.append(r)
        return np.array(rows, np.int64)


def _run(text: str, before: np.ndarray) -> np.ndarray:
    """Letters ``before`` and those of a text, each run of blanks as one."""
    low = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = low == BLANK
    follows = np.append(before[-1:] == BLANK, blank)[:len(low)]
    return np.concatenate([before, low[~(blank & follows)]])


def _codes(run: np.ndarray) -> np.ndarray:
    low = run.astype(np.uint64)
    code = np.zeros(max(len(low) - N + 1, 0), np.uint64)
    for k in range(N):
        code = (code << np.uint64(21)) | low[k:k + len(code)]
    return code


_EDGE = np.array([BLANK], np.uint32)
_END = np.repeat(_EDGE, N - 1)


def grams(text: str) -> np.ndarray:
    """Letter n-grams of a text in order, as numbers of 21 bits a letter."""
    run = _run(text, _EDGE)
    return _codes(np.concatenate([run, _END])) if (run != BLANK).any() else np.zeros(0, np.uint64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and their counts.

    Long texts go in pieces, each behind the last letters of the one before, so
    the n-grams are those of the whole text.
    """
    if len(text) <= SLICE_CHARS:
        return np.unique(grams(text), return_counts=True)
    total: dict[int, int] = {}

    def add(run):
        for g, n in zip(*(a.tolist() for a in np.unique(_codes(run), return_counts=True))):
            total[g] = total.get(g, 0) + n

    run, found = _EDGE, False
    for at in range(0, len(text), SLICE_CHARS):
        run = _run(text[at:at + SLICE_CHARS], run[-(N - 1):])
        found = found or bool((run != BLANK).any())
        add(run)
    add(np.concatenate([run[-(N - 1):], _END]))
    keys = np.array(sorted(total) if found else [], np.uint64)
    return keys, np.array([total[int(k)] for k in keys], np.int64)


def _vectors() -> Vectors:
    kept = worker_cache("langid")
    if "vectors" not in kept:
        kept["vectors"] = Vectors()
    return kept["vectors"]


def bundle(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of n-gram vectors, each as often as it occurs."""
    vectors, out = _vectors(), np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(keys), 8192):
        rows = vectors.get(keys[at:at + 8192].tolist())
        out += counts[at:at + 8192].astype(np.float32) @ vectors.store[rows]
    return out


def learn(docs: DataFrame) -> DataFrame:
    """lang and its prototype: the bundle of all its texts, from rows with a language."""
    def count(batches):
        for batch in batches:
            langs, found = batch.column(1), {}
            for i in range(batch.num_rows):
                own = found.setdefault(langs[i].as_py(), {})
                keys, n = counted(batch.column(0)[i].as_py())
                for g, c in zip(keys.tolist(), n.tolist()):
                    own[g] = own.get(g, 0) + c
            rows = [(lang, g, c) for lang, own in found.items() for g, c in own.items()]
            names, codes, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(codes, pa.int64()),
                                              pa.array(n, pa.int64())], ["lang", "gram", "n"])

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, codes = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.uint64)
            n, names = batch.column(2).to_numpy(), np.array(langs, object)
            for lang in set(langs):
                own = names == lang
                total[lang] = total.get(lang, 0) + bundle(codes[own], n[own])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
            ["lang", "vector"])

    counts = (docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
              .select(F.col("text").cast("string"), F.col("lang").cast("string"))
              .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    parts = counts.mapInArrow(sums, "lang string, vector array<double>")
    return (parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
                                 .alias("vector")))


def predict(docs: DataFrame, prototypes: DataFrame, columns: list[str],
            names: tuple[str, str] = ("lang_pred", "score"),
            unknown: tuple[str | None, str | None] = (UNKNOWN, UNKNOWN)) -> DataFrame:
    """The given columns with the predicted language and its cosine; one small vector per language is broadcast.

    ``unknown`` names the language of texts without letters, and that of others when there is no prototype.
    """
    chosen, cosine_name = names
    known = sorted((r["lang"], r["vector"]) for r in prototypes.collect())
    langs = [*[lang for lang, _ in known], *unknown]
    matrix = np.array([v for _, v in known], np.float64).reshape(len(known), DIMENSIONS)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches):
        langs, matrix = shared.value
        for batch in batches:
            which, scores = [], []
            for text in pc.fill_null(batch.column(0), ""):
                keys, n = counted(text.as_py())
                if not len(keys) or not len(matrix):
                    which.append(len(langs) - (1 if len(keys) else 2))
                    scores.append(0.0)
                    continue
                v = bundle(keys, n)
                cosine = matrix @ (v / max(np.linalg.norm(v), 1e-12))
                which.append(int(np.argmax(np.round(cosine, 12))))
                scores.append(float(min(max(cosine.max(), 0.0), 1.0)))
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                rest + [pa.array(langs, pa.string()).take(pa.array(which, pa.int32())), pa.array(scores, pa.float64())],
                batch.schema.names[1:] + [chosen, cosine_name])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in columns] + [f"{chosen} string", f"{cosine_name} double"])
    return docs.select(F.col("text").cast("string").alias(free_names(docs, "_text_")[0]), *columns).mapInArrow(run, schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    prototypes = learn(docs.filter(learnable(F.col("doc_id"))))
    return predict(docs, prototypes, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
