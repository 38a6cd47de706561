"""Mixing to weights, whitening and cross-tokenizer alignment."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from helpers import SPACED, frame
from tokenizers import Tokenizer

from ridgemark.llm import alignment, mixing, whitening

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _targets(sizes):
    """Shares by weight; targets above the cap stop there and their excess is shared again, in fractions."""
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, out = Fraction(3 * sum(sizes.values()), 2), {}
    while True:
        level = left / max(1, sum(weight[s] for s in sizes if s not in out))
        over = [s for s in sizes if s not in out and level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: float(out.get(s, level * weight[s])) for s in sizes}
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]


def _sources(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, hash string, row string, target string").repartition(5)


def _held(spark, rows):
    docs = _sources(spark, [(*r, "h", "r", "t") for r in rows])
    got = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    few = sorted(map(tuple, mixing.mix(docs, max_sources=0).collect()), key=str)
    assert got == few                                    # tables of sources copied per salt
    words = {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + len(SPACED.findall(t or ""))
    want = _targets(words)
    by = {}
    docs_of = {(i, len(SPACED.findall(t or ""))): s for i, t, s in rows}
    for doc_id, size, source_size, target, taken in got:
        s = docs_of[doc_id, size]
        assert source_size == words[s] and target == pytest.approx(want[s]) and 0 <= taken <= 2 * size
        by.setdefault(s, []).append((size, taken))
    for s, found in by.items():
        assert abs(sum(t for _, t in found) - want[s]) <= max(n for n, _ in found) / 2 + 1e-6, s
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    assert sorted(db.sql(f"select doc_id, size, source_size, target, taken from ({mixing.oracle()})").fetchall(), key=str) == got
    return by


def test_mix_against_fractions_and_sql(spark, texts):
    r = random.Random(5)
    _held(spark, [(i, t, r.choice(["a", "B", "é", None, "", "z"])) for i, t in enumerate(texts)])


def test_mix_of_hot_and_tiny_sources(spark):
    same = [(7, "one two three", "hot")] * 300           # one id and text: only row numbers tell them apart
    by = _held(spark, [*same, (None, None, "empty"), (1, " \t\n", "empty"), (2, "w " * 5000, "long"), (3, "w", None)])
    assert sum(t for _, t in by["hot"]) > 0 and by["empty"] == [(0, 0)] * 2
    assert _held(spark, [(1, None, None)]) and mixing.mix(_sources(spark, [])).count() == 0


def _whitened(spark, vectors):
    rows = spark.createDataFrame([(i, v, "a", "b", 1) for i, v in vectors], "vec_id long, embedding array<float>, at string, x string, n int").repartition(4)
    return sorted(map(tuple, whitening.whiten(rows).collect()), key=lambda r: (str(r[0]), r[1], r[3]))


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(3)
    data = (r.normal(size=(400, 20)) * np.linspace(0.1, 3, 20)).astype(np.float32)
    vectors = [(i, row.tolist()) for i, row in enumerate(data)] + [(1000 + i, data[0].tolist()) for i in range(200)]
    bad = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, []), (2005, [1.0])]
    got = _whitened(spark, vectors + bad)
    x = np.floor(64 * np.array([v for _, v in vectors], np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = (n * x - total) / n
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes / np.sqrt(values)
    assert len(got) == 16 * len(vectors) and all(row[2] == n for row in got)
    order = sorted(range(len(vectors)), key=lambda k: str(vectors[k][0]))
    whitened = np.array([row[4] for row in got]).reshape(-1, 16)
    signs = np.sign(whitened[0] * want[order[0], :16])
    np.testing.assert_allclose(whitened, want[order, :16] * signs, atol=1e-7)
    assert [row[3] for row in got[::16]] == [int(((n * x[k] - total) ** 2).sum()) for k in order]
    np.testing.assert_allclose([row[5] for row in got[:16]], values[:16] / values.sum(), rtol=1e-9)
    assert 0 <= got[0][6] < 1e-9


def test_whitening_over_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    vectors = [(i, row.tolist()) for i, row in enumerate(r.normal(size=(300, 5)).astype(np.float32))]
    want = _whitened(spark, vectors)
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 50)
    monkeypatch.setattr(whitening, "SLICE_BLOCKS", 2)
    got = _whitened(spark, vectors)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4] for g in got], [w[4] for w in want], atol=1e-9)


def test_whitening_of_awkward_tables(spark):
    assert _whitened(spark, []) == [] and _whitened(spark, [(1, None), (2, [])]) == []
    assert [r[1:] for r in _whitened(spark, [(1, [0.5, 0.25]), (None, [0.5, 0.25])])] == [(k, 1, 0, 0.0, 0.0, 0.0) for k in (1, 2)] * 2
    line = _whitened(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])])
    assert [r[4] for r in line if r[1] == 2] == [0.0] * 3 and line[0][5] == 1.0 and line[0][6] < 1e-12


def _aligned(texts):
    """Groups and links of every text by walking over both token lists, encoded by the libraries on whole texts."""
    from sentencepiece import SentencePieceProcessor
    a_lib, b_lib = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    pair = alignment.Pair(A, B)
    held, out = Counter(), []
    for t in texts:
        raw = b" " + (t or "").encode()
        sides = [a_lib.encode(" " + t, add_special_tokens=False).ids if t else [], b_lib.encode(t) if t else []]
        if not t or any(b"".join(names[i] for i in ids) != raw for ids, names in zip(sides, (pair.a_bytes, pair.b_bytes))):
            sides = [[], []]
        spans = []
        for ids, names in zip(sides, (pair.a_bytes, pair.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((i, at, at + len(names[i])))
                at = own[-1][2]
            spans.append(own)
        common = sorted({z for *_, z in spans[0]} & {z for *_, z in spans[1]})
        groups = [[[i for i, _, z in own if lo < z <= hi] for own in spans] for lo, hi in zip([0, *common], common)]
        links, low = [], 0
        for i, s, e in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        held.update(set(links))
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        out.append((len(sides[0]), len(sides[1]), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if text else "", groups, common))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return [(a, b, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha, groups, ends)
            for a, b, g, links, sha, groups, ends in out]


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(2)
    odd = [None, "", " ", "  a  b", "\n\n x\t y \n z", "a▁b c", "<|endoftext|> x <s> y", "é" * 50 + " ünï ☃  𝔘 ", "x" * 3000, "\0 a",
           "日本語 テキスト", " " * 40 + "z", "foo \nbar　baz qux", "'s it's  's", "ﬁ ① ²", " ▁ ", "abc", "abc", "antidisestablishment " * 300]
    letters = ["ab  \n\té▁.,'1日　ß\r", "abcdefgh  \n\té.,'1日", "thein a"]
    return odd + ["".join(r.choice(letters[k % 3]) for _ in range(r.randint(0, 200))) for k in range(150)]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 100, 0])
def test_alignment_against_walk(spark, mixed, heavy):
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.alignment_digest(frame(spark, mixed), A, B, heavy).collect()}
    want = _aligned(mixed)
    assert [got[i] for i in range(len(mixed))] == [w[:7] for w in want]


def test_groups_and_pieces(spark, mixed):
    got = {r["doc_id"]: r["groups"] for r in alignment.aligned_groups(frame(spark, mixed), A, B).collect()}
    for i, w in enumerate(_aligned(mixed)):
        assert [[g["a"], g["b"]] for g in got[i]] == w[7]
        assert [(g["first"], g["end"]) for g in got[i]] == list(zip([0, *w[8]], w[8]))
    whole, cut = alignment.Pair(A, B), alignment.Pair(A, B, piece=5)
    assert all(whole.encode(t or "") == cut.encode(t or "") for t in mixed)


def test_gallop_finds_first_places():
    r = random.Random(9)
    for _ in range(200):
        ends = np.array(sorted(r.sample(range(1, 300), r.randint(1, 60))))
        wanted = np.array([r.randint(1, ends[-1]) for _ in range(30)])
        guess = np.array([r.randint(-5, 70) for _ in wanted])
        low, high = np.zeros(len(wanted), int), np.full(len(wanted), len(ends))
        assert (alignment.gallop(ends, low, high, guess, wanted) == np.searchsorted(ends, wanted)).all()


def test_alignment_of_nothing(spark, nothing):
    assert alignment.alignment_digest(nothing, A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.alignment_digest(frame(spark, [None]), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]
