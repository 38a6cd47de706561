"""BPE against the tokenizers library."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ridgemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.load(PATH)


def ids(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()


def test_random_texts_in_narrow_windows(library, merges):
    r, encoder = random.Random(1), bpe.Encoder(merges, cache=50)
    for _ in range(400):
        letters = r.choice(["ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "thein ", "éèàüñ a", "!?#*$%&.,' ", "́a e\n\t", "ΑΣσİ"])
        text = "".join(r.choice(letters) for _ in range(r.choice([1, 5, 30, 300, 1500])))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(encoder, text) == want
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        assert [t for w in bpe.PIECES.findall(low) for g in merges.stream(w.encode(), 8) for t in g] == want


def test_window_stays_bounded(merges):
    assert max(merges.reach.values()) < bpe.WINDOW
    assert max(len(g) for g in merges.stream(b"the" * 20_000)) <= bpe.WINDOW


def test_special_tokens_and_control_characters(library, merges):
    encoder = bpe.Encoder(merges)
    for text in ("a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z　w", "<|endoftext|", "it's I'LL we've", "", "\n"):
        got = ids(encoder, text)
        assert got == library.encode(text, add_special_tokens=False).ids
        shown = bpe.TokenMachine({i: t.encode() for i, t in merges.text.items()})
        assert b"".join(shown.push(got[k:k + 2]) for k in range(0, len(got), 2)).decode() == library.decode(
            got, skip_special_tokens=False)


def test_text_machine_returns_the_words(merges):
    text = "ünïcode wörds, 12 ☃ and 𝔘"
    machine, out = bpe.TextMachine(merges), ""
    for i in ids(bpe.Encoder(merges), text):
        out += machine.push([i])
    assert (out + machine.finish()).replace(" ", "") == text.replace(" ", "")


def test_digest_of_a_table(docs, texts, nothing, library):
    got = {r["doc_id"]: r for r in bpe.digest(docs, PATH).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        decoded = library.decode(want, skip_special_tokens=False)
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.digest(nothing, PATH).count() == 0
    assert bpe.tokens(docs.filter("doc_id < 20"), PATH).count() == 20
