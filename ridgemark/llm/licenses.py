"""Licence scans with a positional index of rare words.

Each template is a word sequence with a label and a mandatory phrase. Corpus
document frequencies rank the templates' words; each template is filed under
the rarest word of its mandatory phrase with its position. An occurrence of that
word in a file proposes a place for the template; the postings of its other words
must then stand at the same relative positions in at least a given share (weighted
by IDF), and the mandatory phrase must stand there word by word. Every place that
may count holds the phrase, so this one word finds all of them. A base phrase is a
template that is mandatory as a whole.

Words are runs of letters and digits, A-Z in lower case. Null and empty texts
have no words, no labels and score 0. Repeated rows are judged each. The index
and the word frequencies have the fixed size of the templates' vocabulary.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemark.llm.common import LETTERS, Words, text_slices

SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: str                # must stand in it word by word
    base: bool = False


BASE = [Template("cc-by", "cc by", "cc by", True),
        Template("gpl", "general public license", "general public license", True),
        Template("reserved", "all rights reserved", "all rights reserved", True)]
TEMPLATES = [
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
             "is hereby granted", "permission to use copy modify and or distribute this software"),
]


def hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), LETTERS).hash


class Index:
    """Postings of the rarest words of the templates' phrases, given the document frequency of each word."""

    def __init__(self, templates: list[Template], frequency: dict[int, int], n_docs: int):
        self.templates = templates
        self.words = [hashes(t.text) for t in templates]
        self.idf = [np.log((n_docs + 1) / (np.array([frequency.get(int(h), 0) for h in w]) + 0.5)) for w in self.words]
        self.phrase = []
        for t, w in zip(templates, self.words):
            p = hashes(t.phrase)
            k = next(i for i in range(len(w) - len(p) + 1) if (w[i:i + len(p)] == p).all())
            self.phrase.append(np.arange(k, k + len(p)))
        rarest = [int(p[np.argmax(idf[p])]) for idf, p in zip(self.idf, self.phrase)]
        postings = sorted((int(w[q]), i, q) for i, (w, q) in enumerate(zip(self.words, rarest)))
        self.key = np.array([p[0] for p in postings], np.uint64)
        self.template = np.array([p[1] for p in postings], np.int64)
        self.place = np.array([p[2] for p in postings], np.int64)

    def find(self, words: Words) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, documents, starts, share) of every verified place in a slice."""
        low = np.searchsorted(self.key, words.hash)
        at = np.flatnonzero(self.key[np.minimum(low, len(self.key) - 1)] == words.hash)
        low, high = low[at], np.searchsorted(self.key, words.hash[at], "right")
        n = high - low
        at, low = np.repeat(at, n), np.repeat(low, n)
        k = low + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        owner = np.searchsorted(words.first, at, "right") - 1
        start, which, found = at - self.place[k], self.template[k], []
        for t in np.unique(which):
            own = which == t
            pairs = np.unique(np.stack([start[own], owner[own]], 1), axis=0)
            s, doc = pairs[:, 0], pairs[:, 1]
            place = s[:, None] + np.arange(len(self.words[t]))
            inside = (place >= words.first[doc][:, None]) & (place < words.first[doc + 1][:, None])
            equal = inside & (words.hash[np.where(inside, place, 0)] == self.words[t])
            weight = np.maximum(self.idf[t], 1e-9)
            share = equal @ weight / weight.sum()
            good = equal[:, self.phrase[t]].all(1) & ((share >= SHARE) | self.templates[t].base)
            found.append((int(t), doc[good], s[good] - words.first[doc[good]], share[good]))
        return found


def frequencies(docs: DataFrame, templates: list[Template]) -> tuple[dict[int, int], int]:
    """Documents that hold each word of the templates, and documents in all."""
    vocabulary = np.unique(np.concatenate([hashes(t.text) for t in templates]))

    def count(batches):
        total, docs_seen = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            docs_seen += batch.num_rows
            for _, data, offsets in text_slices(batch.column(0)):
                words = Words(data, offsets, LETTERS)
                k = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
                at = np.flatnonzero(vocabulary[k] == words.hash)
                owner = np.searchsorted(words.first, at, "right") - 1
                pairs = np.unique(owner * len(vocabulary) + k[at])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(vocabulary)), pa.int32()), pa.array(np.concatenate([[docs_seen], total]), pa.int64())],
            ["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word int, n long").groupBy("word").agg(
        F.sum("n").alias("n")).collect()                      # one row per word of the templates
    n = {r["word"]: r["n"] for r in rows}
    return {int(h): n.get(k, 0) for k, h in enumerate(vocabulary)}, n.get(-1, 0)


def scan(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """Every verified place: doc_id and its matches (label, base, start, share), with the number of words."""
    index = Index(templates, *frequencies(docs, templates))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    match = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("share", pa.float64())])

    def run(batches):
        index = shared.value
        for batch in batches:
            n_words, found = [], [[] for _ in range(batch.num_rows)]
            for row, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, LETTERS)
                n_words.append(words.counts)
                for t, doc, start, share in index.find(words):
                    own = index.templates[t]
                    for d, s, x in zip(doc.tolist(), start.tolist(), share.tolist()):
                        found[row + d].append({"label": own.label, "base": own.base, "start": s, "share": x})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n_words or [np.zeros(0, np.int64)]), pa.int64()),
                 pa.array(found, pa.list_(match))], ["doc_id", "n_words", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_words long, matches array<struct<label:string,base:boolean,start:long,share:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: words, base places, labels and the best share."""
    found = scan(docs, BASE + TEMPLATES)
    base = F.filter("matches", lambda m: m["base"])

    def labels(c):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.least(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), F.lit(1.0)).alias("score"))
