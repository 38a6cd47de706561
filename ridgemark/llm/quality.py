"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over the whole text in steps of STEP; their largest
responses are taken in overlapping chunks. Largest, mean and smallest chunk
responses over the text go through a small hidden layer to one probability.
Texts are zero-padded at their end, so every byte of every text is covered;
empty and null texts have zero responses and the score of those.

The network is fitted on a bounded sample of labelled documents: at most SAMPLE
learnable ones per label, those first in the order of a hash of the id, of
SAMPLE_BYTES at most each. Labels whose value is null, or documents without a
label, are not learned from; a document with several labels counts with each.
Everything else covers all documents: scoring is one narrow pass.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.llm.common import held_out, learnable, text_slices

WIDTH, STEP, FILTERS, HIDDEN = 8, 2, 32, 16
CHUNK, STRIDE = 256, 224         # positions
SAMPLE, SAMPLE_BYTES = 1500, 1 << 16
STEPS, RATE, BATCH = 600, 0.004, 48
KEEP = 0.3
SLICE = 1 << 18
TOGETHER = 128                   # chunks whose responses are held at once


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with WIDTH zeros behind each text; the positions of all filters, and where each text's begin."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros(len(data) + WIDTH * n + WIDTH, np.uint8)
    out[np.arange(len(data)) + WIDTH * np.repeat(np.arange(n), sizes)] = data
    counts = -(-sizes // STEP)
    first = np.concatenate([[0], np.cumsum(counts)])
    place = (np.arange(first[-1]) - np.repeat(first[:-1], counts)) * STEP
    return out, place + np.repeat(offsets[:-1] + WIDTH * np.arange(n), counts), first


def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the overlapping chunks of positions, and where each text's begin."""
    counts = np.diff(first)
    n = np.where(counts == 0, 0, 1 + np.maximum(0, -(-(counts - CHUNK) // STRIDE)))
    begin = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(begin[-1]) - np.repeat(begin[:-1], n)
    start = np.repeat(first[:-1], n) + k * STRIDE
    return start, np.minimum(start + CHUNK, np.repeat(first[1:], n)), begin


def _over(values: np.ndarray, start: np.ndarray, end: np.ndarray, how) -> np.ndarray:
    """``how`` over rows start..end, which are not empty."""
    at = np.stack([start, end], 1).ravel()
    return how.reduceat(np.concatenate([values, values[:1]]), at)[::2] if len(start) else values[:0]


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"table": r.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
                  "w1": r.normal(0, 0.2, (3 * FILTERS, HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32),
                  "w2": r.normal(0, 0.3, HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32)}

    def responses(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.broadcast_to(self.p["bias"], (len(at), FILTERS)).copy()
        part = np.empty_like(out)
        for w in range(WIDTH):
            np.take(self.p["table"][w], data[at + w], axis=0, out=part)
            out += part
        return out

    def pooled(self, data: np.ndarray, offsets: np.ndarray):
        raw, at, first = padded(data, offsets)
        start, end, begin = chunks(first)
        r = self.responses(raw, at)
        return raw, at, start, end, begin, r, np.maximum(_over(r, start, end, np.maximum), 0)

    def head(self, z: np.ndarray, begin: np.ndarray):
        n = len(begin) - 1
        f = np.zeros((n, 3, FILTERS), np.float32)
        full = np.flatnonzero(np.diff(begin))
        if len(full):
            a, b = begin[:-1][full], begin[1:][full]
            f[full, 0] = _over(z, a, b, np.maximum)
            f[full, 1] = _over(z, a, b, np.add) / (b - a)[:, None]
            f[full, 2] = _over(z, a, b, np.minimum)
        h = np.tanh(f.reshape(n, -1) @ self.p["w1"] + self.p["b1"])
        return f, h, h @ self.p["w2"] + self.p["b2"][0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw, at, first = padded(data, offsets)
        start, end, begin = chunks(first)
        z = np.zeros((len(start), FILTERS), np.float32)
        for c in range(0, len(start), TOGETHER):         # a few chunks at a time, however long the text is
            own = slice(c, c + TOGETHER)
            low = start[c]
            r = self.responses(raw, at[low:end[own][-1]])
            z[own] = np.maximum(_over(r, start[own] - low, end[own] - low, np.maximum), 0)
        return 1 / (1 + np.exp(-np.clip(self.head(z, begin)[2].astype(np.float64), -30, 30)))

    def gradients(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        raw, at, start, end, begin, r, z = self.pooled(data, offsets)
        f, h, logit = self.head(z, begin)
        n = len(labels)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - labels).astype(np.float32) / n
        g = {"w2": h.T @ d, "b2": np.array([d.sum()], np.float32)}
        dh = d[:, None] * self.p["w2"] * (1 - h * h)
        g["w1"], g["b1"] = f.reshape(n, -1).T @ dh, dh.sum(0)
        df = (dh @ self.p["w1"].T).reshape(n, 3, FILTERS)
        owner = np.repeat(np.arange(n), np.diff(begin))
        size = np.maximum(np.diff(begin), 1)[:, None]
        dz = df[owner, 1] / size[owner]
        for k in (0, 2):
            dz += np.where(z == f[owner, k], df[owner, k], 0)
        dz[z <= 0] = 0
        # Each chunk passes its gradient to the position of the largest response.
        g["table"], g["bias"] = np.zeros_like(self.p["table"]), dz.sum(0)
        for c in range(len(start)):
            live = np.flatnonzero(dz[c])
            if len(live):
                best = at[start[c] + r[start[c]:end[c], live].argmax(0)]
                for w in range(WIDTH):
                    np.add.at(g["table"][w], (raw[best + w], live), dz[c, live])
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> "Network":
        """Steps over batches that hold as many texts of either label."""
        r = np.random.default_rng(seed)
        sides = [side for side in (np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)) if len(side)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1) if sides else ():
            part = np.concatenate([r.choice(side, BATCH // len(sides)) for side in sides])
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
            g = self.gradients(np.frombuffer(b"".join(texts[i] for i in part), np.uint8), offsets, labels[part])
            rate = RATE * (1 - (step - 1) / steps)
            for name, x in g.items():
                m[name] += 0.1 * (x - m[name])
                v[name] += 0.001 * (x * x - v[name])
                first, second = m[name] / (1 - 0.9 ** step), v[name] / (1 - 0.999 ** step)
                self.p[name] -= (rate * first / (np.sqrt(second) + 1e-8)).astype(np.float32)
        return self


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """The bounded sample: learnable labelled texts and their labels."""
    order = F.xxhash64("doc_id")
    chosen = None
    for value in (0, 1):
        part = (labels.filter(learnable(F.col("doc_id")) & (F.col("quality") == value))
                .select("doc_id", F.lit(value).alias("label")).orderBy(order, "doc_id").limit(2 * bound))
        chosen = part if chosen is None else chosen.unionByName(part)
    text = F.col("text").cast("string")
    known = docs.select("doc_id", text.alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    found = known.join(F.broadcast(chosen), "doc_id").withColumn("o", order)      # at most 4 x bound ids
    rows = []
    for value in (0, 1):
        rows += found.filter(F.col("label") == value).orderBy("o", "doc_id", "text").limit(bound).collect()
    return [r["text"].encode() for r in rows], np.array([r["label"] for r in rows], np.float32)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    network = Network().fit(*sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(data, offsets) for _, data, offsets in text_slices(batch.column(1), SLICE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= KEEP).cast("int").alias("predicted"))
