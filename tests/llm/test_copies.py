"""Near copies, repeated bytes and benchmark passages against brute force."""

import hashlib
import itertools

import numpy as np
import pytest
from helpers import LETTERS, frame, jaccard_components, repeated_spans, without, words
from pyspark.sql import functions as F

from ridgemark.llm import components, decontaminate, jaccard, suffixes
from ridgemark.llm.common import LETTERS as WORD_BYTES
from ridgemark.llm.common import Words


@pytest.mark.parametrize("region", [500_000, 300])
def test_jaccard_components(docs, texts, monkeypatch, region):
    monkeypatch.setattr(jaccard, "REGION", region)       # small: blocks of a region in pairs
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components_of(docs).collect()}
    assert got == jaccard_components(texts)


def chains(lengths, seed=5):
    """Groups of texts of which only neighbours in a chain of edits are linked, and whose rarest shingles are common to the group."""
    r = np.random.default_rng(seed)
    edits = [[" ".join(f"{side}{k}x{i}" for i in range(9)) for k in range(16)] for side in "st"]
    texts = [" ".join(edits[0] + edits[1])] * 30         # makes the edited passages the most frequent ones
    for g, n in enumerate(lengths):
        own = " ".join(f"g{g}w{i}" for i in range(160 - 9 * (n - 1)))
        texts += [" ".join([own, *(edits[k < j][k] for k in range(n - 1))]) for j in range(n)]
    return [texts[i] for i in r.permutation(len(texts))]


@pytest.mark.parametrize("region", [500_000, 700, 100])
def test_jaccard_of_chains_in_rounds(spark, monkeypatch, region):
    """Sets linked to different pivots are still compared, in later rounds, in one task and in blocks."""
    monkeypatch.setattr(jaccard, "REGION", region)
    texts = chains([4] * 16 + [7, 8, 9, 10] * 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components_of(frame(spark, texts)).collect()}
    want = jaccard_components(texts)
    assert len({root for _, root in want.values()}) == 25
    assert got == want


def test_finish_compares_different_cells():
    base = np.arange(100, dtype=np.uint64)
    sets = [np.concatenate([base[:100 - 7 * k], 1000 + base[:7 * k]]) for k in range(4)]
    ids = [b"a", b"x", b"y", b"b"]
    assert jaccard.finish(ids, sets, [0, 0, 1, 1], (85, 100)) == [(b"x", b"y")]
    assert jaccard.finish(ids, sets, [0, 0, 0, 0], (85, 100)) == []
    assert len(jaccard.finish(ids, sets, [None, 0, 1, None], (85, 100))) == 3


def test_jaccard_of_awkward_tables(spark, nothing):
    assert jaccard.components_of(nothing).count() == 0
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, None), (9, ""), (None, "z")]
    got = jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [
        got[0].__class__(doc_id=d, n_shingles=n, component_id=c) for d, n, c in
        [(None, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9), (9, 0, 9), (None, 1, None)]]))


def test_components_of_a_long_path(spark):
    links = spark.range(40).selectExpr("cast(cast(id as string) as binary) as u", "cast(cast(id + 1 as string) as binary) as v")
    found = components.components(links).collect()
    assert len(found) == 41 and len({bytes(r["root"]) for r in found}) == 1


@pytest.mark.parametrize("group", [20_000, 3])
def test_repeated_bytes(docs, texts, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)        # small: windows dealt out by their hashes
    monkeypatch.setattr(suffixes.window_matches, "__defaults__", (group,))
    got = {r["doc_id"]: r for r in suffixes.digest(docs).collect()}
    for i, spans in enumerate(repeated_spans(texts)):
        raw = (texts[i] or "").encode()
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), sum(z - a for a, z in spans), len(spans)), i
        assert r["kept_sha256"] == hashlib.sha256(without(raw, spans)).hexdigest()


def test_cut_texts(docs, texts, nothing):
    spans = repeated_spans(texts)
    got = {r["doc_id"]: r for r in suffixes.cut_texts(docs).collect()}
    for i, t in enumerate(texts):
        rest = without((t or "").encode(), spans[i]).decode("utf-8", "ignore")
        if spans[i] and not rest.strip():
            assert i not in got
        else:
            assert (got[i]["text"] or "") == rest and got[i]["sid"] == "x"
    assert suffixes.cut_texts(nothing).count() == 0 and suffixes.cut_texts(docs).columns == docs.columns


def test_decontamination(spark, docs, texts, nothing):
    r = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [" ".join(r.choice(vocabulary, n)) for n in (40, 25, 9, 5, 3, 30)]
    changed = items[0].split()
    for k in range(3, 40, 7):
        changed[k] = "other"
    own = [*texts, "Before. " + items[1].upper() + "! after", "x " + " ".join(changed) + " y", items[2], items[3] + " tail",
           items[4], " ".join(items[0].split()[:10]), " ".join(items[5].split()[8:24]), items[1] + " " + items[2]]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(6, items[1]), (7, None), (8, "")], "item_id long, text string")
    found = decontaminate.matches(frame(spark, own), table)
    n = len(texts)
    want = {(n, 1), (n, 6), (n + 1, 0), (n + 2, 2), (n + 3, 3), (n + 6, 5), (n + 7, 1), (n + 7, 6), (n + 7, 2)}
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want
    kept = {x["doc_id"] for x in decontaminate.clean(frame(spark, own), table).collect()}
    assert kept == set(range(len(own))) - {d for d, _ in want}
    assert decontaminate.matches(nothing, table).count() == 0
    assert decontaminate.matches(docs, table.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(4, 17))
def test_short_items_with_changed_words(n):
    """Every way to change as many words as four fifths allow is found; four words are not testable."""
    item = [f"k{i}" for i in range(n)]
    seeds = decontaminate.Seeds([" ".join(item)])
    for gone in itertools.combinations(range(n), n // 5 if n < 13 else 2):
        text = " ".join(["pre", "fix", *("other" if i in gone else w for i, w in enumerate(item)), "tail"]).encode()
        raw = np.frombuffer(text, np.uint8)
        found = list(decontaminate.overlaps(seeds, Words(raw, np.array([0, len(raw)]), WORD_BYTES)))
        assert bool(found) == (n >= 5), gone
    assert (decontaminate.SHORT_MASKS[0] in seeds.masks) == (5 <= n <= 7)


def test_overlap_in_small_blocks(spark, monkeypatch):
    """Test items in several blocks give the same pairs."""
    rows = [(i, " ".join(f"k{i}w{j}" for j in range(20))) for i in range(30)]
    docs = spark.createDataFrame([(i, "pre " + t) for i, t in rows], "doc_id long, text string")
    items = spark.createDataFrame(rows, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    assert {tuple(r) for r in decontaminate.matches(docs, items).select("doc_id", "item_id").collect()} == {(i, i) for i in range(30)}


def test_longest_stretch():
    equal = np.array([1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 1], bool)
    assert [int(x[0]) for x in decontaminate.longest(equal, np.array([13]))] == [0, 10, 8]
    r = np.random.default_rng(1)
    sizes = r.integers(1, 30, 300)
    equal = r.random(sizes.sum()) < r.choice([0.1, 0.7, 0.95], 300).repeat(sizes)
    for run, found in zip(np.split(equal, np.cumsum(sizes)[:-1]), zip(*decontaminate.longest(equal, sizes))):
        ways = [(s - e, s, e) for s in range(len(run)) for e in range(s + 1, len(run) + 1) if 5 * run[s:e].sum() >= 4 * (e - s)]
        _, s, e = min(ways, default=(0, 0, 0))
        assert found == (s, e, run[s:e].sum())
    assert words("Cc-BY 4.0", LETTERS) == ["cc", "by", "4", "0"]


def test_overlaps_against_all_offsets(monkeypatch):
    """Every stretch of eight words and more that agrees in four fifths, at any offset, is found and the best of a pair told."""
    r = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(12)]
    common = " ".join(r.choice(vocabulary, 9))
    items = [" ".join([*r.choice(vocabulary, n), common]) for n in (3, 6, 11, 15)] + [" ".join(r.choice(vocabulary, n)) for n in (13, 20, 9)]
    texts = []
    for k in range(60):
        w = items[k % len(items)].split()
        for at in r.integers(0, len(w), k % 5):
            w[at] = str(r.choice(vocabulary))
        texts.append(" ".join([*r.choice(vocabulary, k % 7), *w, *r.choice(vocabulary, 5), common]))
    texts += ["", "alone", common]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b, best = text.split(), item.split(), None
            for start in range(1 - len(b), len(a)):
                low, high = max(0, -start), min(len(b), len(a) - start)
                equal = np.array([a[start + p] == b[p] for p in range(low, high)])
                for s in range(len(equal)):
                    for e in range(s + min(13, len(b)), len(equal) + 1):
                        n = int(equal[s:e].sum())
                        if 5 * n >= 4 * (e - s):
                            best = min(best or (0,), (s - e, -n, start + low + s, low + s))
            if best:
                want.add((d, i, -best[0], -best[1], best[2], best[3]))
    for places in (1 << 19, 40):
        monkeypatch.setattr(decontaminate, "PLACES", places)
        got = {tuple(x) for x in decontaminate.overlaps(decontaminate.Seeds(items), Words(raw, offsets, WORD_BYTES)).tolist()}
        assert {x[:3] for x in got} == {x[:3] for x in want}, (got ^ want)
    assert len(want) > 40


def test_texts_with_equal_hashes(docs, texts, monkeypatch):
    """Different texts that share their hash are told apart."""
    monkeypatch.setattr(suffixes, "_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    spans = repeated_spans(texts)
    got = {r["doc_id"]: r for r in suffixes.digest(docs).collect()}
    assert {i: (got[i]["n_removed"], got[i]["n_spans"]) for i in got} == {
        i: (sum(z - a for a, z in own), len(own)) for i, own in enumerate(spans)}
