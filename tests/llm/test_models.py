"""Language profiles, the quality network and the pipeline."""

import os

import numpy as np
import public_tokenizers
import pytest
from helpers import frame, jaccard_components, repeated_spans, without
from pyspark.sql import functions as F

import corpus_pipeline
from ridgemark.llm import bpe, common, langid, quality, stages


def _held_out(df):
    return df.filter("held_out")


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = _held_out(langid.identify_languages(docs)).join(docs, "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.98


def test_language_of_awkward_texts(spark, nothing):
    texts = ["the cat sat on the mat with the hat"] * 8 + ["le chat est sur la table avec le chapeau"] * 8 + [
        None, "", "12 !?", "the mat", "la table", "the " * 200_000, "日本", "İ"]
    langs = ["en"] * 8 + ["fr"] * 8 + [None] * 8
    got = {r["doc_id"]: r for r in langid.identify_languages(frame(spark, texts, langs)).collect()}
    assert [got[i]["lang_pred"] for i in range(16, 22)] == ["und", "und", "und", "en", "fr", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[16]["score"] == 0
    assert langid.identify_languages(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(frame(spark, ["abc", None], [None, None])).collect()} == {"und"}


def test_bundles_are_sums_of_bound_vectors():
    keys, n = langid.counted("Abc abc")
    want = np.zeros(langid.DIMENSIONS)
    text = " abc abc  "
    for k in range(len(text) - 2):
        v = np.ones(langid.DIMENSIONS)
        for j, ch in enumerate(reversed(text[k:k + 3])):
            v *= np.roll(langid.letter_vector(ord(ch)), j)
        want += v
    np.testing.assert_allclose(langid.bundle(keys, n), want)


def test_network_scores_do_not_depend_on_slices():
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 7, 8, 600, 5000)]
    net = quality.Network()
    together = net.score(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    alone = [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    np.testing.assert_allclose(together, alone, rtol=1e-5)


def test_network_against_loops():
    """The forward pass filter by filter and place by place, in small groups of chunks too."""
    r = np.random.default_rng(1)
    net = quality.Network()
    p = net.p
    texts = [bytes(r.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 9, 300, 1400)]
    want = []
    for t in texts:
        raw = t + bytes(quality.WIDTH)
        rows = [sum((p["table"][w, raw[at + w]] for w in range(quality.WIDTH)), p["bias"].astype(np.float64))
                for at in range(0, len(t), quality.STEP)]
        z, k = [], 0
        while rows and (k == 0 or k + quality.CHUNK - quality.STRIDE < len(rows)):
            z.append(np.maximum(np.max(rows[k:k + quality.CHUNK], axis=0), 0))
            k += quality.STRIDE
        f = np.concatenate([np.max(z, 0), np.mean(z, 0), np.min(z, 0)]) if z else np.zeros(3 * quality.FILTERS)
        want.append(1 / (1 + np.exp(-(np.tanh(f @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0]))))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    np.testing.assert_allclose(net.score(data, offsets), want, rtol=1e-4)
    whole = quality.TOGETHER
    try:
        quality.TOGETHER = 2
        np.testing.assert_allclose(net.score(data, offsets), want, rtol=1e-4)
    finally:
        quality.TOGETHER = whole


def test_network_gradients():
    """Against differences of the loss."""
    texts = [b"good words here and there", b"bad ### bad ### bad"]
    data, offsets, y = np.frombuffer(b"".join(texts), np.uint8), np.array([0, 25, 44]), np.array([1, 0], np.float32)
    net = quality.Network()

    def loss():
        p = net.score(data, offsets)
        return -np.mean(np.log(np.where(y == 1, p, 1 - p)))

    g = net.gradients(data, offsets, y)
    for name, at in (("w1", (3, 2)), ("w2", (4,)), ("b1", (1,)), ("bias", (5,)), ("table", (0, ord("#"), 3))):
        was = net.p[name][at]
        net.p[name][at] = was + 1e-2
        high = loss()
        net.p[name][at] = was - 1e-2
        low = loss()
        net.p[name][at] = was
        assert abs((high - low) / 2e-2 - g[name][at]) < 5e-3


def test_quality_accuracy(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_documents(docs.unionByName(docs.limit(1).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")), labels)
    got = _held_out(scored).join(labels, "doc_id").toPandas()
    assert ((got["predicted"] == got["quality"]).mean() > 0.9) and scored.filter("score between 0 and 1").count() == docs.count() + 1
    assert quality.score_documents(nothing, labels).count() == 0


def test_pipeline_stages_against_brute_force(spark, texts):
    """Every stage on its own input: what it keeps, and what it does to it."""
    langs = ["en"] * len(texts)
    docs = frame(spark, texts, langs).select("doc_id", "text", "lang", "source", "n_chars")
    data = "/root/testdata/sf0.001"
    kept = stages.language(spark, docs, data)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    one = {r["doc_id"] for r in stages.near_duplicates(spark, docs, data).collect()}
    assert one == {i for i, (n, c) in jaccard_components(texts, 5, (80, 100)).items() if i == c}
    four = {r["doc_id"] for r in stages.near_duplicates(spark, docs, data, 4, (85, 100)).collect()}
    assert four == {i for i, (n, c) in jaccard_components(texts).items() if i == c}
    spans = repeated_spans(texts)
    cut = {r["doc_id"]: r for r in stages.repeated_passages(spark, docs, data).collect()}
    for i, r in cut.items():
        rest = without((texts[i] or "").encode(), spans[i]).decode("utf-8", "ignore")
        assert (r["text"] or "") == rest and r["n_chars"] == (None if texts[i] is None else len(rest))
    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    dirty = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("text", F.lit("a " + item)))
    assert {r["doc_id"] for r in stages.benchmark_free(spark, dirty, data).collect()} == set(range(len(texts)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
        assert stage(spark, docs.limit(0), data).count() == 0


def test_language_stage_without_prototypes(spark):
    rows = [(0, "plain words", None), (1, "more words", None), (2, "12 34", None), (3, None, None), (4, "", None)]
    for langs in (None, "und"):                  # no language at all; a language with the name of none
        docs = spark.createDataFrame([(i, t, langs) for i, t, _ in rows], "doc_id long, text string, lang string")
        assert {r["doc_id"] for r in stages.language(spark, docs, "").collect()} == {0, 1}


def test_near_duplicates_of_repeated_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u"), (2, None), (7, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stages.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == [(2, ""), (2, "q r s t u"), (5, "a b c d e f"), (7, "")]


def test_stages_with_clashing_columns(spark, texts):
    """Columns named like inner ones come through every stage unchanged."""
    extra = ("_key_", "_KEY2_", "_known_", "_gone_", "_tid_", "_ranges_", "_found_", "_lang_pred_", "_score_", "_text_")
    docs = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(c).alias(c) for c in extra])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.select(*extra).distinct().collect()] == [extra]


def test_tables_of_a_stage_are_deleted(spark, tmp_path):
    since = common.written()
    path = common.stored(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.release(spark, since)
    assert not os.path.exists(os.path.dirname(path)) and common.written() == since


def test_pipeline_runs(spark):
    data = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, data)
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert 0 < out.count() < n and [s for s, _ in corpus_pipeline.STAGES][0] == "language"
    assert out.columns == bpe.digest(spark.read.parquet(f"{data}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), ids=True).columns


def test_long_texts_have_the_n_grams_of_the_whole(monkeypatch):
    r = np.random.default_rng(7)
    texts = ["".join(r.choice(list("ab é1  \n"), n)) for n in (1, 2, 3, 7, 8, 9, 60, 301)] + ["a" * 600, " " * 50, "1 2 " * 30, " a" * 40]
    want = [np.unique(langid.grams(t), return_counts=True) for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "SLICE_CHARS", size)
        for t, (keys, n) in zip(texts, want):
            got = langid.counted(t)
            assert got[0].tolist() == keys.tolist() and got[1].tolist() == n.tolist()


def test_predictions_against_loops(spark):
    """Every n-gram bound letter by letter, every text and language bundled, all cosines compared."""
    import random
    import zlib
    r = random.Random(1)
    words_of = {"x": ["ba", "be", "bibo"], "y": ["kra", "kri", "krokru"], "z": ["ona", "uno", "ino"]}
    langs = [r.choice("xyz") for _ in range(60)]
    texts = [" ".join(r.choice(words_of[s if r.random() < 0.7 else r.choice("xyz")]) for _ in range(r.randint(1, 12))) for s in langs]

    def vector(text):
        out = np.zeros(langid.DIMENSIONS)
        padded = " " + " ".join(text.split()) + "  "
        for k in range(len(padded) - 2):
            v = np.ones(langid.DIMENSIONS)
            for j, ch in enumerate(reversed(padded[k:k + 3])):
                v = v * np.roll(langid.letter_vector(ord(ch)), j)
            out += v
        return out

    made = [vector(t) for t in texts]
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    prototypes = {s: sum(made[i] for i in learned if langs[i] == s) for s in "xyz"}
    got = {d["doc_id"]: d for d in langid.identify_languages(frame(spark, texts, langs)).collect()}
    for i, v in enumerate(made):
        cosines = {s: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for s, p in prototypes.items()}
        best = max(cosines.values())
        assert got[i]["score"] == pytest.approx(best) and cosines[got[i]["lang_pred"]] == pytest.approx(best)
        assert got[i]["held_out"] == (i not in learned)


def test_language_stage_fills_and_chooses(spark):
    texts, langs = ["the cat sat on the mat"] * 9 + ["le chat est sur la table"] * 9 + ["le chat", "the cat", "12", None], ["en"] * 9 + ["fr"] * 9 + [None] * 4
    docs = frame(spark, texts, langs)
    kept = {r["doc_id"]: r["lang"] for r in stages.language(spark, docs, "").collect()}
    assert kept == {**dict(enumerate(langs[:18])), 18: "fr", 19: "en"}
    assert {r["doc_id"] for r in stages.language(spark, docs, "", ("fr",)).collect()} == {*range(9, 19)}


def test_encoded_ids_are_those_of_the_digest(spark):
    import hashlib
    docs = frame(spark, ["one two", None, "", "Ünïcode wörds " * 50])
    for r in bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True).collect():
        assert len(r["ids"]) == r["n_tokens"] and hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"]
